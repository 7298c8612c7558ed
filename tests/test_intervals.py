"""Joins of intervals against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from siftwood.operators.intervals import blocks_of_interval, innermost, overlaps, positions_within
from siftwood.plans import queries_spans

SPAN = "k string, lo long, hi long, tag string"


def made(seed, n):
    rng = random.Random(seed)
    lengths = (0, 1, 15, 16, 17, 255, 256, 5000, 70_000, 2_000_000)
    rows = []
    for i in range(n):
        lo = rng.randrange(-300, 3000) if i % 3 else rng.randrange(-3_000_000, 3_000_000)
        rows.append(("hot" if i % 3 else f"k{i % 5}", lo, lo + rng.choice(lengths) + rng.randrange(-1, 3), f"t{i}"))
    return [*rows, rows[0], (None, 0, 9, "no key"), ("hot", None, 4, "no begin"), ("hot", 4, None, "no end"), ("hot", 9, 3, "reversed")]


def sound(r):
    return None not in r[:3] and r[1] <= r[2]


def test_blocks_meet_the_interval(spark):
    for lo, hi in ((0, 0), (-17, 40), (5, 5 + 2**12), (15, 16), (-(2**20), 2**20 + 3), (7, 6)):
        found = spark.range(1).select(blocks_of_interval(F.lit(lo), F.lit(hi)).alias("b")).first().b
        if lo > hi:
            assert found is None
            continue
        assert len({b.grid for b in found}) == 1
        size = 2 ** found[0].grid
        assert [b.block for b in found] == list(range(lo // size, hi // size + 1))
        assert len(found) <= 2 or size == 2**16


def test_overlaps_and_positions(spark):
    a, b = made(1, 240), made(2, 260)
    left, right = spark.createDataFrame(a, SPAN).repartition(3), spark.createDataFrame(b, SPAN)
    want = sorted((x[3], y[3]) for x in a for y in b if sound(x) and sound(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    found = overlaps(left, right, ["k"])
    assert sorted(found.select("left.tag", "right.tag").toPandas().itertuples(index=False, name=None)) == want and len(want) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    inside = positions_within(left, right, ["k"], "lo").select("position.tag", "interval.tag")
    assert sorted(inside.toPandas().itertuples(index=False, name=None)) == sorted((x[3], y[3]) for x in a for y in b if x[1] is not None and sound(y) and x[0] == y[0] and y[1] <= x[1] <= y[2])


def test_one_key_is_dealt_out_by_blocks(spark):
    long = spark.range(4000).select(F.lit("one").alias("k"), (F.col("id") * 16).alias("lo"), (F.col("id") * 16 + 20).alias("hi"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [r[1] for r in overlaps(long, long, ["k"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(parts) == 4000 + 2 * 3999
    assert max(parts) < sum(parts) / 2


def test_innermost(spark):
    a, b = made(3, 200), made(4, 150)
    got = innermost(spark.createDataFrame(a, SPAN), spark.createDataFrame(b, SPAN), ["k"])
    assert got.columns == ["k", "lo", "hi", "tag", "outer_lo", "outer_hi"]

    def best(x):
        held = [(y[2] - y[1], y[1], y[2]) for y in b if sound(x) and sound(y) and x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]]
        return min(held)[1:] if held else (None, None)

    want = sorted(((x[3], *best(x)) for x in a), key=str)
    assert sorted(((r.tag, r.outer_lo, r.outer_hi) for r in got.collect()), key=str) == want
    assert any(w[1] is not None for w in want) and any(w[1] is None for w in want)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SPAN), spark.createDataFrame([("k", 1, 2, "t")], SPAN)
    assert overlaps(none, some, ["k"]).count() == overlaps(some, none, ["k"]).count() == 0
    assert innermost(some, none, ["k"]).collect() == [("k", 1, 2, "t", None, None)]


@pytest.mark.parametrize("name", ["window_sentences", "sentence_chunks"])
def test_texts_are_cut_once_and_no_side_is_broadcast(spark, sf_dir, name):
    plan = queries_spans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "BroadcastExchange" not in plan
