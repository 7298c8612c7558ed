"""Segments against an index built anew, over updates, merges, snapshots and the vacuum."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwood.functions.text import index_tokens
from siftwood.operators import codes, lexical, segments, vector
from siftwood.sources import store

COLUMNS = "id long, path string, text string, dl int"
EDITS = int(os.environ.get("TEST_EDITS", "22"))
WORDS = [f"w{i}" for i in range(40)]


def made(spark, path, **kw):
    return segments.SegmentIndex(spark, str(path), COLUMNS, F.col("text"), **kw)


def put(index, docs, mtime=1.0):
    """Documents {path: text}; a text of None deletes."""
    spark = index.spark
    rows = spark.createDataFrame([(p, mtime, 1, t is None) for p, t in docs.items()], "path string, mtime double, size long, deleted boolean")
    texts = spark.createDataFrame([(p, t) for p, t in docs.items() if t is not None], "path string, text string")
    return index.update(rows, texts.select(F.xxhash64("path", "text").alias("id"), "path", "text", F.size(index_tokens(F.col("text"))).alias("dl")))


def text(rng):
    return " ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(40)], k=rng.randrange(1, 30)))


def fresh(spark, docs):
    rows = spark.createDataFrame([(p, t) for p, t in docs.items() if t is not None], "path string, text string")
    return lexical.build_index(rows.select(F.xxhash64("path", "text").alias("chunk_id"), F.col("text").alias("body")))


def ranked(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(0, "w0 w39 w20"), (1, "w38"), (2, "w0 w0 w1 nothing"), (3, "absent"), (4, "")], "query_id long, query string")


def test_updates_equal_an_index_built_anew(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(segments, "RANGE_CHUNKS", 4)
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 3)
    rng, index, docs = random.Random(1), made(spark, tmp_path / "i", lease=0), {}
    counts = []
    for step in range(9):
        new = {f"f{rng.randrange(90)}": None if rng.random() < 0.2 else text(rng) for _ in range(80 if step == 0 else 6)}
        docs |= new
        state = put(index, new, float(step))
        counts.append(len(state["segments"]))
        assert state["chunks"] == sum(t is not None for t in docs.values())
    assert max(counts) <= segments.MOST_SEGMENTS and counts[-1] > 1
    now = index.leased()
    assert {(r.path, r.text) for r in now.chunks().collect()} == {(p, t) for p, t in docs.items() if t is not None}
    assert {(r.path, r.deleted) for r in now.files().collect()} == {(p, t is None) for p, t in docs.items()}
    anew = fresh(spark, docs)
    want = ranked(lexical.bm25_topk(anew, asked, 7))
    assert ranked(lexical.bm25_topk(now.lexical(asked), asked, 7)) == want
    assert ranked(now.bm25_topk(asked, 7, seeds=2)) == want
    df = {r.term: r.df for r in now.index.read("terms", now.segments).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").collect()}
    assert df == {r.term: r.df for r in anew.term_df.collect()}


def test_bounds_skip_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE_CHUNKS", 4)
    rng, index = random.Random(2), made(spark, tmp_path / "i")
    docs = {f"f{i}": " ".join(["common"] + [f"x{rng.randrange(200)}" for _ in range(20)]) + (" rare rare rare" if i % 97 == 0 else "") for i in range(500)}
    put(index, docs)
    one = spark.createDataFrame([(0, "common rare")], "query_id long, query string")
    now = index.leased()
    assert ranked(now.bm25_topk(one, 5, seeds=6)) == ranked(lexical.bm25_topk(fresh(spark, docs), one, 5))
    assert now.skipped.ranges > 100 and now.skipped.skipped > now.skipped.ranges * 0.8 and now.skipped.literal


def test_terms_are_literals_of_one_scan(spark, tmp_path, asked):
    index = made(spark, tmp_path / "i")
    rng = random.Random(4)
    put(index, {f"f{i}": text(rng) for i in range(60)})
    put(index, {"g": "w1 w2"})
    plan = index.leased().lexical(asked).postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PushedFilters" in plan and "In(term, [" in plan


def test_many_edits_leave_size_and_segments_constant(spark, tmp_path):
    rng, index = random.Random(3), made(spark, tmp_path / "i", lease=0)
    put(index, {f"f{i}": text(rng) for i in range(200)})
    sizes, folders = [], []
    for step in range(EDITS):
        put(index, {f"f{step % 5}": text(rng)}, 2.0 + step)
        sizes.append(store.size(spark, index.path))
        folders.append(sum(len(store.names(spark, f"{index.path}/{t}")) for t in index.schemas))
    assert max(folders) <= 5 * segments.MOST_SEGMENTS
    assert max(sizes[EDITS // 2 :]) < 1.1 * max(sizes[: EDITS // 2])
    assert index.state()["chunks"] == 200


def test_readers_keep_their_rows(spark, tmp_path):
    index = made(spark, tmp_path / "i", lease=0)
    put(index, {"a": "w1 w2", "b": "w3"})
    one = spark.createDataFrame([(0, "w1")], "query_id long, query string")
    with index.snapshot() as old:
        rows, found = old.chunks(), lexical.bm25_topk(old.lexical(one), one, 3)
        for step in range(6):
            put(index, {"a": f"w{step + 5}", "b": None}, 2.0 + step)
        assert sorted(r.text for r in rows.collect()) == ["w1 w2", "w3"] and found.count() == 1
        held = set(store.names(spark, f"{index.path}/chunks"))
    gone = index.vacuum()
    assert gone and set(store.names(spark, f"{index.path}/chunks")) < held
    assert [r.text for r in index.leased().chunks().collect()] == ["w10"] and not store.names(spark, f"{index.path}/pins")
    # a lease keeps what a search was planned on
    leased = made(spark, tmp_path / "i", lease=300)
    rows = leased.leased().chunks()
    put(leased, {"a": "w20"}, 9.0)
    assert [r.text for r in rows.collect()] == ["w10"]


def test_an_update_that_stops_is_done_again(spark, tmp_path, monkeypatch):
    index = made(spark, tmp_path / "i")
    put(index, {"a": "w1"})
    whole = segments.SegmentIndex._terms
    monkeypatch.setattr(segments.SegmentIndex, "_terms", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        put(index, {"a": "w2", "b": "w2"})
    assert [r.text for r in index.leased().chunks().collect()] == ["w1"]
    monkeypatch.setattr(segments.SegmentIndex, "_terms", whole)
    put(index, {"a": "w2", "b": "w2"})
    one = spark.createDataFrame([(0, "w2 w1")], "query_id long, query string")
    assert index.leased().bm25_topk(one, 5).count() == 2


def test_empty_index(spark, tmp_path, asked):
    index = made(spark, tmp_path / "i")
    assert index.leased().chunks().count() == 0 and index.leased().files().count() == 0
    put(index, {"a": None})
    assert lexical.bm25_topk(index.leased().lexical(asked), asked).count() == 0 and index.leased().bm25_topk(asked).count() == 0


def bad_vectors(rng, n, width=8):
    rows = [(i, [rng.gauss(0, 1) for _ in range(width)]) for i in range(n)]
    rows += [(n + 1, [float("nan")] + [0.1] * (width - 1)), (n + 2, [float("inf")] * width), (n + 3, None), (n + 4, []), (n + 5, [None] * width), (n + 6, [0.0] * width), (n + 7, [0.5])]
    return rows


def test_vectors_that_are_not_finite_take_no_part(spark):
    rng = random.Random(5)
    rows = bad_vectors(rng, 30)
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    q = spark.createDataFrame([(1, rows[0][1]), (2, [float("nan")] * 8), (3, rows[1][1])], "query_id long, vec array<double>")
    got = vector.nearest_batch(v, q, 5).collect()
    exact = lambda a: sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if b and len(b) == 8 and all(x is not None and abs(x) < 1e300 for x in b)))[:5]
    for name in (1, 3):
        assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == name] == [i for _, i in exact(rows[name // 2][1])]
    assert {r.query_id for r in got} == {1, 3}
    one = vector.nearest_to(v.filter("vec IS NULL OR size(vec) = 8"), F.array(*map(F.lit, rows[0][1])), 5).collect()
    assert [r.chunk_id for r in one] == [i for _, i in exact(rows[0][1])]


@pytest.mark.parametrize("literal", [0, 5000])
def test_two_phases_equal_one(spark, tmp_path, monkeypatch, literal):
    monkeypatch.setattr(codes, "LITERAL_IDS", literal)
    rng = random.Random(6)
    rows = bad_vectors(rng, 2000)
    rows += [(5000 + i, rows[i][1]) for i in range(20)]  # ties
    v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(6)
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(12)] + [(50, rows[3][1]), (51, None), (52, [0.0] * 8), (53, [2.0])], "query_id long, vec array<double>")
    codes.write_codes(v, str(tmp_path / "c"))
    read = codes.Read()
    flat = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert flat(codes.nearest_in_two_phases(spark, str(tmp_path / "c"), q.filter("query_id <> 52"), 10, read)) == flat(vector.nearest_batch(v, q.filter("query_id <> 52"), 10))
    assert read.vectors == 2000 + 2 + 20 and 10 < read.whole < 500
    assert flat(codes.nearest_in_two_phases(spark, str(tmp_path / "c"), q, 10)) == flat(vector.nearest_batch(v, q, 10))


def test_codes_meet_queries_in_tiles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codes, "TILE_QUERIES", 3)
    monkeypatch.setattr(codes, "TILE_CODES", 5)
    rng = random.Random(9)
    v = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4 if i % 7 else 3)]) for i in range(60)], "id long, vec array<double>")
    rows = pa.Table.from_batches(codes.encode(v).toArrow().to_batches()).combine_chunks().to_batches()[0]
    asked = vector._by_width([(i, [float(i), 1.0, 0.5, 2.0]) for i in range(10)])
    tiles = list(codes._intervals(rows, asked))
    assert max(low.shape for *_, low, _ in tiles) <= (3, 5) and sum(low.size for *_, low, _ in tiles) == 10 * sum(1 for i in range(60) if i % 7)


def test_postings_of_several_files_are_made_once(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(segments, "FILE_TOKENS", 100)
    written, whole = [], segments.materialise
    monkeypatch.setattr(segments, "materialise", lambda df, name: written.append(name) or whole(df, name))
    rng, index = random.Random(11), made(spark, tmp_path / "i")
    docs = {f"f{i}": text(rng) for i in range(60)}
    put(index, docs)
    assert written == ["counted"]
    assert ranked(lexical.bm25_topk(index.leased().lexical(asked), asked, 7)) == ranked(lexical.bm25_topk(fresh(spark, docs), asked, 7))
