"""Exact medians against those of Python."""

import random
import statistics

from pyspark.sql import functions as F

from siftwood.operators.median import medians


def test_medians_are_exact(spark):
    rng = random.Random(8)
    rows = [("hot", 7.0, i % 3) for i in range(900)]  # one value has most of the rows
    rows += [("hot", rng.random(), 1) for _ in range(301)] + [("even", float(i), None) for i in range(10)] + [("none", None, None), (None, 2.5, 4), (None, -1e300, 5)]
    df = spark.createDataFrame(rows, "k string, x double, y int").repartition(5)
    got = {r.k: (r.x, r.y) for r in medians(df, ["k"], {"x": F.col("x"), "y": F.col("y")}).collect()}
    middle = lambda k, i: statistics.median([r[i] for r in rows if r[0] == k and r[i] is not None])
    assert got == {"hot": (middle("hot", 1), middle("hot", 2)), "even": (4.5, None), None: (middle(None, 1), 4.5)}
    plan = medians(df, ["k"], {"x": F.col("x")})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_medians_of_all_rows_and_of_none(spark):
    df = spark.createDataFrame([(3,), (1,), (2,), (None,)], "x int")
    assert medians(df, [], {"m": F.col("x"), "n": F.col("x") * 2}).collect() == [(2.0, 4.0)]
    assert medians(df.limit(0), [], {"m": F.col("x")}).collect() == [(None,)]
    assert medians(df.limit(0), ["x"], {"m": F.col("x") + 0}).count() == 0
