"""The lexical ranking against SQLite's full-text search, and the shape of the plans."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from siftwood.operators import lexical, manifest, rank, vector
from siftwood.plans import queries_retrieval

QUERIES = ["the onerth lichkeit", "éeau les le le mentre", "und der ciónra", "anonth", "of in a"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_as_the_full_text_engine(spark, sf_dir, query):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE fts USING fts5(body)")
    con.executemany("INSERT INTO fts (rowid, body) VALUES (?, ?)", [(r.doc_id + 1, r.text.replace("_", " ")) for r in rows])
    queries = spark.createDataFrame([(0, query)], "query_id long, query string")
    terms = [t for r in lexical.terms_of_queries(queries).collect() for t in [r.term] * r.qtf]
    want = [i - 1 for (i,) in con.execute("SELECT rowid FROM fts WHERE fts MATCH ? ORDER BY rank LIMIT 50", (" OR ".join(f'"{t}"' for t in terms),))] if terms else []
    docs = spark.createDataFrame(rows).select("doc_id", F.col("text").alias("body"))
    got = [r.chunk_id for r in lexical.bm25_topk(lexical.build_index(docs, "doc_id"), queries).orderBy("rank").collect()]
    assert got == want


def test_nearest_batch_is_exact_in_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BYTES", 3 * 64 * 8)
    monkeypatch.setattr(vector, "VECTOR_BYTES", 100 * 64 * 8)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    queries = v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    got = {(r.query_id, r["rank"]): r.chunk_id for r in vector.nearest_batch(v, queries, 5).collect()}
    rows = [(r.id, r.vec) for r in v.collect()]
    for q, x in [(i, w) for i, w in rows if i % 50 == 0]:
        best = sorted(rows, key=lambda r: (-sum(a * b for a, b in zip(x, r[1], strict=True)), r[0]))[:5]
        assert [got[q, i + 1] for i in range(5)] == [b[0] for b in best]


def test_single_query_plans_a_bounded_top_k(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    plan = plan_of(vector.nearest_to(v, F.array(*[F.lit(0.1)] * 64), id_col="vec_id", vec_col="embedding"))
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "Exchange" not in plan


def test_batch_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    queries = spark.createDataFrame([(0, "the onerth lichkeit")], "query_id long, query string")
    plan = plan_of(lexical.bm25_topk(lexical.build_index(docs, "doc_id"), queries, 10))
    assert "WindowGroupLimit" in plan and "BroadcastHashJoin" in plan and "Python" not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("text", "body")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(lexical.tokens_of(docs, "doc_id"))


def test_ties_keep_the_order_of_the_rankings(spark):
    near = spark.createDataFrame([(0, 7, 1), (0, 8, 2)], "query_id long, chunk_id long, rank int")
    words = spark.createDataFrame([(0, 9, 1), (0, 5, 2)], "query_id long, chunk_id long, rank int")
    best = rank.best(rank.fuse(near, words, 1.0), 50).orderBy("place").collect()
    assert [r.chunk_id for r in best] == [7, 9, 8, 5]


@pytest.mark.parametrize(("k", "want"), [(0, 1), (-3, 1), (7, 7), (99, 50)])
def test_top_k_is_clamped(k, want):
    assert rank.clamp_k(k) == want


def test_manifest_differences(spark):
    kind = "path string, mtime double, size long"
    known = spark.createDataFrame([("same", 1.0, 1), ("time", 1.0, 1), ("size", 1.0, 1), ("gone", 1.0, 1)], kind)
    current = spark.createDataFrame([("same", 1.0, 1), ("time", 2.0, 1), ("size", 1.0, 2), ("new", 1.0, 1)], kind)
    assert {r.path for r in manifest.changed(known, current).collect()} == {"time", "size", "new"}
    assert {r.path for r in manifest.removed(known, current).collect()} == {"gone"}
    empty = spark.createDataFrame([], kind)
    assert manifest.changed(empty, empty).count() == 0 and manifest.removed(known, empty).count() == 4


def test_vectors_with_nulls_and_of_other_lengths(spark):
    kind = "id long, vec array<float>"
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [None, 1.0]), (4, None), (5, []), (6, [1.0, 0.0, 0.0])], kind)
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [None, 1.0]), (13, [0.0, 0.0, 1.0])], "query_id long, vec array<float>")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in vector.nearest_batch(v, queries, 5).collect())
    assert got == [(10, 1, 1), (10, 2, 2), (13, 1, 6)]
    assert vector.nearest_batch(v, queries.limit(0), 5).count() == 0 and vector.nearest_batch(v.limit(0), queries, 5).count() == 0


def test_an_index_reads_texts_once_and_stored_terms_alone(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    index = lexical.build_index(docs, "doc_id")
    assert docs.count() == index.lengths.count() and "documents.parquet" not in plan_of(index.postings)
    # the stored one reads the texts for its chunks and no more, then the postings of the terms alone (test_segments.py)
    queries = spark.createDataFrame([(0, "the onerth lichkeit")], "query_id long, query string")
    stored = queries_retrieval.stored_documents(spark, sf_dir).lexical(queries)
    assert "In(term, [" in plan_of(stored.postings) and "documents.parquet" not in plan_of(stored.postings)
    key = lambda df: sorted((r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert key(lexical.bm25_topk(stored, queries, 10)) == key(lexical.bm25_topk(index, queries, 10))


def test_any_number_of_rankings_is_fused(spark):
    kind = "query_id long, chunk_id long, rank int"
    a, b, c = (spark.createDataFrame([(0, i, n) for n, i in enumerate(ids, 1)], kind) for ids in ((1, 2), (2, 3), (3, 1)))
    got = {r.chunk_id: (r.a, r.b, r.c, r.score) for r in rank.fuse_all([("a", a, 1.0), ("b", b, 0.5), ("c", c, 0.25)]).collect()}
    assert got == {1: (1, None, 2, 1 / 61 + 0.25 / 62), 2: (2, 1, None, 1 / 62 + 0.5 / 61), 3: (None, 2, 1, 0.5 / 62 + 0.25 / 61)}


def test_stored_indexes_follow_their_table(spark, sf_dir, tmp_path):
    """A table that is written anew is indexed anew."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = str(tmp_path / "documents.parquet")
    docs.write.parquet(at)
    first = {r.doc_id for r in queries_retrieval.indexed_topk(spark, str(tmp_path)).collect()}
    docs.filter(~docs.doc_id.isin(*first)).write.mode("overwrite").parquet(at)
    spark.catalog.refreshByPath(at)
    for query in (queries_retrieval.indexed_topk, queries_retrieval.bounded_topk):
        found = {r.doc_id for r in query(spark, str(tmp_path)).collect()}
        assert len(found) == 10 and not found & first


def test_batch_scores_shuffle_no_row_a_query_and_chunk(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 50)
    docs = spark.createDataFrame([(i, f"aaa b{i % 3} aaa c{i}") for i in range(60)], "chunk_id long, body string")
    asked = spark.createDataFrame([(q, f"aaa b{q % 3} c{q}") for q in range(10)], "query_id long, query string")
    index = lexical.build_index(docs, queries=asked)
    assert {(r.term, r.chunk_id): r.tf for r in index.postings.filter("chunk_id = 4").collect()} == {("aaa", 4): 2, ("b1", 4): 1, ("c4", 4): 1}
    rows = lexical.bm25_scores(index, asked)
    physical = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\w+, chunk_id", physical) and "hashpartitioning(chunk_id" in physical
    monkeypatch.setattr(lexical, "PAIRS", 10**9)
    assert sorted(lexical.bm25_scores(index, asked).collect()) == sorted(rows.collect())


def test_an_index_is_made_without_a_shuffle(spark):
    plan = lexical.postings_of(spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "chunk_id long, body string"), mark=True)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, plan.select("term", "chunk_id", "tf").collect())) == [("", 1, 1), ("", 2, 1), ("", 3, 1), ("a", 1, 1), ("b", 1, 2)]
