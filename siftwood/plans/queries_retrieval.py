"""Registered queries over retrieval, result shaping and index maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions import text as tx
from siftwood.operators import codes, lexical, manifest, rank, vector
from siftwood.operators.scratch import scratch_path
from siftwood.operators.segments import SegmentIndex, Snapshot
from siftwood.operators.sizing import broadcast_if_small
from siftwood.sources import sinks, store

from .queries_text import CLIP, LINES, PATH, STOP, STRIPPED, sql_terms, sql_text, sql_tokens, sql_words

QUERY = "onerth tionthe lichkeit der éeau ciónra les thand einung how do the onerth las"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def one_query(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT 0L AS query_id, '{QUERY}' AS query")


def bench_queries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def doc_index(spark: SparkSession, d: str, queries: DataFrame | None = None) -> lexical.LexicalIndex:
    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return lexical.build_index(docs, "doc_id", queries=queries)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")


def bm25_stats(spark, d):
    i = doc_index(spark, d)
    return i.term_df.crossJoin(F.broadcast(i.totals)).select("term", "df", "n", F.round("avgdl", 9).alias("avgdl"))  # totals is one row


def bm25_topk(spark, d):
    top = lexical.bm25_topk(doc_index(spark, d, one_query(spark)), one_query(spark), 10)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source", "n_chars")
    return docs.join(F.broadcast(top), "chunk_id").select("rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "lang", "source", "n_chars")  # top is ten rows


_stored: dict[tuple[str, str, str, str], str] = {}


def _folder(spark: SparkSession, d: str, table: str, kind: str, make) -> str:
    """The folder of a stored index of a table as it is now: made by the first query of an application, and again when the files of the table are others."""
    key = (spark.sparkContext.applicationId, d, kind, store.signature(spark, read(spark, d, table).inputFiles()))
    if key not in _stored:
        path = scratch_path(spark, kind)
        make(path)
        _stored[key] = path
    return _stored[key]


def _segments(spark: SparkSession, path: str) -> SegmentIndex:
    return SegmentIndex(spark, path, "id long, path string, text string, dl int", F.coalesce(F.col("text"), F.lit("")))


def _as_files(docs: DataFrame, mtime: float, deleted: bool = False) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.lit(mtime).alias("mtime"), F.col("n_chars").cast("long").alias("size"), F.lit(deleted).alias("deleted"))


def _as_chunks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), "text", F.size(tx.index_tokens(F.coalesce("text", F.lit("")))).alias("dl"))


def stored_documents(spark: SparkSession, d: str) -> Snapshot:
    """The segmented index of documents."""
    docs = read(spark, d, "documents")
    path = _folder(spark, d, "documents", "index", lambda p: _segments(spark, p).update(_as_files(docs, 1.0), _as_chunks(docs)))
    return _segments(spark, path).leased()


def indexed_topk(spark, d):
    """One query against the stored index: the row groups of its terms are all that is read of the postings."""
    q = one_query(spark)
    top = lexical.bm25_topk(stored_documents(spark, d).lexical(q), q, 10)
    return top.select("rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def indexed_batch(spark, d):
    q = bench_queries(spark, d)
    top = lexical.bm25_topk(stored_documents(spark, d).lexical(q), q, 10)
    return top.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def bounded_topk(spark, d):
    """One query against the stored index, reading only the ranges of ids whose bounds come up to the tenth score."""
    top = stored_documents(spark, d).bm25_topk(one_query(spark), 10)
    return top.select("rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def bounded_batch(spark, d):
    top = stored_documents(spark, d).bm25_topk(bench_queries(spark, d), 10)
    return top.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def _edited_documents(spark: SparkSession, d: str) -> Snapshot:
    """The index of documents after two updates: those of one language get the query appended, those of another and of no language go."""
    docs = read(spark, d, "documents")

    def make(path: str) -> None:
        index = _segments(spark, path)
        index.update(_as_files(docs, 1.0), _as_chunks(docs))
        longer = docs.filter("lang = 'de'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" " + QUERY)))
        index.update(_as_files(longer, 2.0), _as_chunks(longer))
        gone = docs.filter("lang = 'fr' OR lang IS NULL")
        index.update(_as_files(gone, 3.0, True), _as_chunks(gone.limit(0)))

    return _segments(spark, _folder(spark, d, "documents", "edited", make)).leased()


def edited_batch(spark, d):
    """Rankings over a base segment, a segment of new versions and one of deletions."""
    q = bench_queries(spark, d)
    top = lexical.bm25_topk(_edited_documents(spark, d).lexical(q), q, 10)
    return top.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def knn_codes(spark, d):
    """knn_batch in two phases: codes of a byte a component, then the vectors that these cannot exclude."""
    path = _folder(spark, d, "embeddings", "codes", lambda p: codes.write_codes(vectors(spark, d), p))
    near = codes.nearest_in_two_phases(spark, path, query_vectors(spark, d), 10)
    return near.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), F.round("score", 9).alias("score"))


def bm25_batch(spark, d):
    top = lexical.bm25_topk(doc_index(spark, d, bench_queries(spark, d)), bench_queries(spark, d), 10)
    return top.select("query_id", "rank", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def knn_topk(spark, d):
    v = vectors(spark, d)
    q = v.filter("id = 0").select(F.col("vec").alias("q"))
    both = v.crossJoin(F.broadcast(q))  # q is one row
    near = vector.nearest_to(both, F.col("q"))
    return near.select(F.col("chunk_id").alias("vec_id"), F.round("score", 9).alias("score"))


def knn_batch(spark, d):
    near = vector.nearest_batch(vectors(spark, d), query_vectors(spark, d), 10)
    return near.select("query_id", "rank", F.col("chunk_id").alias("vec_id"), F.round("score", 9).alias("score"))


def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    return read(spark, d, "embeddings").select("vec_id", F.transform(tx.l2_normalise(scaled), lambda x: F.round(x, 7)).alias("unit"))


def _fused(spark, d, queries, asked):
    keyword = lexical.bm25_topk(doc_index(spark, d, queries), queries)
    return rank.fuse(vector.nearest_batch(vectors(spark, d), asked), keyword)


def _one_vector(spark, d):
    return vectors(spark, d).filter("id = 0").select(F.col("id").alias("query_id"), "vec")


def rrf_fusion(spark, d):
    return _fused(spark, d, one_query(spark), _one_vector(spark, d)).select(F.col("chunk_id").alias("doc_id"), "vec_rank", "kw_rank", F.round("score", 9).alias("score"))


#: Other phrasings of the query, and what their rankings weigh beside its own.
PHRASINGS, PHRASING_WEIGHT = ("lichkeit der onerth", "les thand einung"), 0.25


def phrasing_fusion(spark, d):
    """The keyword rankings of a query and of its other phrasings, fused."""
    asked = spark.createDataFrame(list(enumerate((QUERY, *PHRASINGS))), "query_id long, query string")
    found = lexical.bm25_topk(doc_index(spark, d, asked), asked)
    one = lambda i: found.filter(F.col("query_id") == i).withColumn("query_id", F.lit(0))
    fused = rank.fuse_all([(f"r{i}", one(i), PHRASING_WEIGHT if i else 1.0) for i in range(1 + len(PHRASINGS))])
    return fused.select(F.col("chunk_id").alias("doc_id"), "r0", "r1", "r2", F.round("score", 9).alias("score"))


def _hybrid(spark, d, queries, asked, k):
    docs = read(spark, d, "documents").select("doc_id", F.expr(PATH).alias("path"), "text")
    fused = broadcast_if_small(_fused(spark, d, queries, asked), known_by=queries, per_row=2 * lexical.CANDIDATES)
    rows = docs.join(fused, F.col("doc_id") == F.col("chunk_id")).join(broadcast_if_small(queries), "query_id")
    rows = rows.withColumn("score", rank.reweigh(F.col("score"), F.col("query"), F.col("path"), F.col("text")))
    rows = rows.withColumns({"line_start": F.lit(1), "line_end": F.size(tx.text_lines(F.col("text"))), "kind": F.lit("text"), "images": (F.col("doc_id") % 3).cast("int")})
    return rank.best(rows, k)


def hybrid_topk(spark, d):
    return _hybrid(spark, d, one_query(spark), _one_vector(spark, d), 10).select("place", "doc_id", "path", F.round("score", 9).alias("score"))


def hybrid_batch(spark, d):
    asked = vectors(spark, d).select(F.col("id").alias("query_id"), "vec").join(bench_queries(spark, d).select("query_id"), "query_id", "left_semi")
    return _hybrid(spark, d, bench_queries(spark, d), asked, 5).select("query_id", "place", "doc_id", F.round("score", 9).alias("score"))


def _results(spark, d, detail="full"):
    return rank.shape(_hybrid(spark, d, one_query(spark), _one_vector(spark, d), 10), detail)


def result_shape(spark, d):
    return _results(spark, d)


def result_outline(spark, d):
    return _results(spark, d, "outline").select("place", "path", "snippet")


def format_text(spark, d):
    return rank.format_text(_results(spark, d)).select(F.md5(F.col("report").cast("binary")).alias("report_md5"), F.length("report").alias("chars"))


def result_json(spark, d):
    return sinks.result_json(_results(spark, d).drop("snippet"))


def _snapshots(spark, d):
    old = read(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.lit(1.0).alias("mtime"), F.col("n_chars").alias("size"), "doc_id")
    new = old.filter("doc_id % 10 <> 0").select("path", F.expr("CASE WHEN doc_id % 7 = 0 THEN 2.0D ELSE mtime END").alias("mtime"), F.expr("CASE WHEN doc_id % 11 = 0 THEN size + 1 ELSE size END").alias("size"))
    added = old.filter("doc_id % 10 = 5").select(F.concat(F.lit("new/"), "path").alias("path"), "mtime", "size")
    return old.drop("doc_id"), new.unionByName(added)


def manifest_changed(spark, d):
    return manifest.changed(*_snapshots(spark, d))


def manifest_removed(spark, d):
    return manifest.removed(*_snapshots(spark, d))


def apply_delta(spark, d):
    old, new = _snapshots(spark, d)
    changed = manifest.changed(old, new)
    gone = manifest.removed(old, new).unionByName(changed)
    return manifest.apply_delta(old, gone, new.join(changed, "path", "left_semi"))


def meta_upsert(spark, d):
    e = read(spark, d, "events")
    old = e.filter("event_id % 2 = 0").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    new = e.filter("user_id % 3 = 0").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max("event_id").cast("string").alias("value"))
    return manifest.upsert(old, new)


def meta_upsert_all(spark, d):
    """Counts of all events by user, over which the last purchase of those who made one is written."""
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", "event_type")
    old = e.groupBy("key").agg(F.count(F.lit(1)).cast("string").alias("value"))
    new = e.groupBy("key").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).cast("string").alias("value")).filter("value IS NOT NULL")
    return manifest.upsert(old, new)


def index_stats(spark, d):
    docs = read(spark, d, "documents")
    return docs.agg(F.count_distinct("source").alias("files"), F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("text")).alias("bytes"), F.max("doc_id").alias("last_id"))


def candidate_union(spark, d):
    """Ids of both rankings, their words in common with the query and what the query has beyond a stop list."""
    ids = _fused(spark, d, one_query(spark), _one_vector(spark, d)).select(F.col("chunk_id").alias("doc_id"))
    words = F.array_distinct(tx.words(F.col("text")))
    asked = tx.words(F.lit(QUERY))
    docs = read(spark, d, "documents").select("doc_id", words.alias("w")).join(F.broadcast(ids), "doc_id")  # at most two rankings of fifty
    return docs.select("doc_id", F.size(F.array_intersect("w", asked)).alias("shared"), F.size(F.array_except(asked, "w")).alias("missing"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_stats, bm25_topk, bm25_batch, indexed_topk, indexed_batch, bounded_topk, bounded_batch, edited_batch, phrasing_fusion, knn_topk, knn_batch, knn_codes, l2_normalize, rrf_fusion, hybrid_topk, hybrid_batch, result_shape, result_outline, format_text, result_json,
        manifest_changed, manifest_removed, apply_delta, meta_upsert, meta_upsert_all, index_stats, candidate_union,
    )
}

# ---- SQL ---------------------------------------------------------------------------------

_INDEX = f"""tok AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents), len AS (SELECT doc_id, len(t) AS dl FROM tok), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_ONE = f"(SELECT 0 AS query_id, '{QUERY}' AS query)"
_PHRASED = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate((QUERY, *PHRASINGS))) + ") AS t(query_id, query))"
_BENCH = "(SELECT item_id AS query_id, text AS query FROM benchmark)"


def _bm25(queries: str) -> str:
    return f"""{_INDEX}, qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_terms('query')}) AS term FROM {queries}) GROUP BY ALL),
bm AS (SELECT query_id, post.doc_id, sum(floor(qtf * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) * 1099511627776 + 0.5)::BIGINT) / 1099511627776::DOUBLE AS score
  FROM qt JOIN df USING (term) JOIN post USING (term) JOIN len ON len.doc_id = post.doc_id, tot GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM bm QUALIFY rank <= 50)"""


_SIM = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _hybrid_sql(queries: str, asked: str) -> str:
    return f"""{_bm25(queries)},
near AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id)::INT AS rank FROM embeddings a, embeddings b WHERE {asked} QUALIFY rank <= 50),
f AS (SELECT query_id, doc_id, near.rank AS vec_rank, kw.rank AS kw_rank, coalesce(0.6::DOUBLE / (60 + near.rank), 0) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0) AS fused FROM near FULL JOIN kw USING (query_id, doc_id)),
p AS (SELECT doc_id, {PATH} AS path, text FROM documents),
r AS (SELECT f.*, path, text, fused * CASE WHEN NOT regexp_matches(query, '(?i)\\btest') AND regexp_matches(path, '(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\\.[A-Za-z0-9_]+$|\\.(test|spec)\\.[A-Za-z0-9_]+$') THEN 0.8 ELSE 1 END
  * CASE WHEN NOT regexp_matches(query, '(?i)\\b(how (do|can|to)|docs?|documentation|guide|example|tutorial|explain|why)\\b') AND regexp_matches(path, '(?i)\\.(md|mdx|markdown|rst|txt)$|(^|/)docs?/') THEN 0.8 ELSE 1 END AS score
  FROM f JOIN p USING (doc_id) JOIN {queries} q USING (query_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(vec_rank, kw_rank + 50))::INT AS place FROM r)"""


_H1 = _hybrid_sql(_ONE, "a.vec_id = 0")
_NOTE = f"""CASE WHEN doc_id % 3 > 0 THEN {sql_text(rank.IMAGE_NOTE, "'section'", 'doc_id % 3')} END"""
_NLINES = "len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))::INT"
_OLD = "(SELECT concat('f', doc_id) AS path, 1.0::DOUBLE AS mtime, n_chars AS size, doc_id FROM documents)"
_NEW = f"(SELECT path, CASE WHEN doc_id % 7 = 0 THEN 2.0 ELSE mtime END AS mtime, CASE WHEN doc_id % 11 = 0 THEN size + 1 ELSE size END AS size FROM {_OLD} WHERE doc_id % 10 <> 0 UNION ALL SELECT concat('new/', path), mtime, size FROM {_OLD} WHERE doc_id % 10 = 5)"
_CHANGED = f"(SELECT n.path FROM {_NEW} n LEFT JOIN {_OLD} o USING (path) WHERE (n.mtime, n.size) IS DISTINCT FROM (o.mtime, o.size))"
_WORDS = f"list_distinct(regexp_extract_all(lower(replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[\\p{{L}}\\p{{N}}_]+'))"

ORACLES = {
    "bm25_stats": f"WITH {_INDEX} SELECT term, df, n, round(avgdl, 9) AS avgdl FROM df, tot",
    "bm25_topk": f"WITH {_bm25(_ONE)} SELECT rank, doc_id, round(score, 6) AS score, lang, source, n_chars FROM kw JOIN documents USING (doc_id) WHERE rank <= 10",
    "bm25_batch": f"WITH {_bm25(_BENCH)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM kw WHERE rank <= 10",
    "indexed_topk": f"WITH {_bm25(_ONE)} SELECT rank, doc_id, round(score, 6) AS score FROM kw WHERE rank <= 10",
    "indexed_batch": f"WITH {_bm25(_BENCH)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM kw WHERE rank <= 10",
    "bounded_topk": f"WITH {_bm25(_ONE)} SELECT rank, doc_id, round(score, 6) AS score FROM kw WHERE rank <= 10",
    "bounded_batch": f"WITH {_bm25(_BENCH)} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM kw WHERE rank <= 10",
    "edited_batch": f"""WITH edited AS (SELECT doc_id, CASE WHEN lang = 'de' THEN concat(text, ' {QUERY}') ELSE text END AS text FROM documents WHERE lang <> 'fr'),
        {_bm25(_BENCH).replace("FROM documents", "FROM edited")} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM kw WHERE rank <= 10""",
    "phrasing_fusion": f"""WITH {_bm25(_PHRASED)}, f AS (SELECT doc_id, {", ".join(f"min(CASE WHEN query_id = {i} THEN rank END) AS r{i}" for i in range(3))} FROM kw GROUP BY doc_id)
        SELECT *, round(coalesce(1.0::DOUBLE / (60 + r0), 0) + coalesce({PHRASING_WEIGHT}::DOUBLE / (60 + r1), 0) + coalesce({PHRASING_WEIGHT}::DOUBLE / (60 + r2), 0), 9) AS score FROM f""",
    "result_outline": f"""WITH {_H1}, t AS (SELECT list_distinct(list_filter({sql_words(f"'{QUERY}'")}, lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))) AS terms),
        top AS (SELECT place, path, doc_id, text FROM best WHERE place <= 10), s AS (SELECT doc_id, ln, {STRIPPED} AS s FROM {LINES.format(t='top')}),
        h AS (SELECT doc_id, list(s ORDER BY ln)[:2] AS head FROM s WHERE s <> '' GROUP BY doc_id),
        m AS (SELECT s.doc_id, ln, s, len(list_intersect(list_distinct({sql_words('s')}), terms)) AS hits FROM s JOIN h USING (doc_id), t WHERE NOT list_contains(head, s)),
        b AS (SELECT doc_id, ln + 2 AS pos, concat('… ', s) AS c FROM m WHERE hits >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ln) <= 2
          UNION ALL SELECT doc_id, unnest(range(len(head))), unnest(head) FROM h)
        SELECT place, path, coalesce(string_agg({CLIP.format(c='c')}, chr(10) ORDER BY pos), '') AS snippet FROM top LEFT JOIN b USING (doc_id) GROUP BY place, path""",
    "result_json": f"""WITH {_H1} SELECT query_id::BIGINT AS query_id, concat('[', string_agg(concat('{{"path":"', path, '","line_start":1,"line_end":', {_NLINES}, ',"score":', round(score, 4), ',"kind":"text"',
        CASE WHEN doc_id % 3 > 0 THEN concat(',"note":"', {_NOTE}, '"') END, '}}'), ',' ORDER BY place), ']') AS results FROM best WHERE place <= 10 GROUP BY query_id""",
    "knn_topk": f"SELECT b.vec_id AS vec_id, round({_SIM}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_SIM} DESC, b.vec_id LIMIT 50",
    "knn_batch": f"SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id)::INT AS rank, b.vec_id AS vec_id, round({_SIM}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10",
    "knn_codes": f"SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id)::INT AS rank, b.vec_id AS vec_id, round({_SIM}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10",
    "l2_normalize": "SELECT vec_id, list_transform(v, lambda x: round(x / (sqrt(list_inner_product(v, v)) + 1e-9), 7)) AS unit FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) AS v FROM embeddings)",
    "rrf_fusion": f"WITH {_H1} SELECT doc_id, vec_rank, kw_rank, round(fused, 9) AS score FROM f",
    "hybrid_topk": f"WITH {_H1} SELECT place, doc_id, path, round(score, 9) AS score FROM best WHERE place <= 10",
    "hybrid_batch": f"WITH {_hybrid_sql(_BENCH, 'a.vec_id IN (SELECT item_id FROM benchmark)')} SELECT query_id, place, doc_id, round(score, 9) AS score FROM best WHERE place <= 5",
    "result_shape": f"WITH {_H1} SELECT query_id, place, path, 1 AS line_start, {_NLINES} AS line_end, text AS snippet, round(score, 4) AS score, 'text' AS kind, NULL::INT AS page, {_NOTE} AS note FROM best WHERE place <= 10",
    "format_text": f"""WITH {_H1}, t AS (SELECT string_agg(concat(path, ':1-', {_NLINES}, chr(10), '  ', replace(regexp_replace(text, '\\n$', ''), chr(10), concat(chr(10), '  ')),
        coalesce(chr(10) || '  [note] ' || {_NOTE}, '')), chr(10) || chr(10) ORDER BY place) AS report FROM best WHERE place <= 10) SELECT md5(report) AS report_md5, length(report)::INT AS chars FROM t""",
    "manifest_changed": f"SELECT path FROM {_CHANGED}",
    "manifest_removed": f"SELECT path FROM {_OLD} WHERE path NOT IN (SELECT path FROM {_NEW})",
    "apply_delta": f"SELECT path, mtime, size FROM {_OLD} WHERE path IN (SELECT path FROM {_NEW}) AND path NOT IN (SELECT path FROM {_CHANGED}) UNION ALL SELECT * FROM {_NEW} WHERE path IN (SELECT path FROM {_CHANGED})",
    "meta_upsert": """WITH o AS (SELECT user_id::VARCHAR AS key, count(*)::VARCHAR AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id::VARCHAR AS key, max(event_id)::VARCHAR AS value FROM events WHERE user_id % 3 = 0 GROUP BY 1)
        SELECT key, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (key)""",
    "meta_upsert_all": "SELECT user_id::VARCHAR AS key, coalesce(max(event_id) FILTER (WHERE event_type = 'purchase'), count(*))::VARCHAR AS value FROM events GROUP BY 1",
    "index_stats": "SELECT count(DISTINCT source) AS files, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes, max(doc_id) AS last_id FROM documents",
    "candidate_union": f"WITH {_H1}, q AS (SELECT list_distinct(regexp_extract_all(lower('{QUERY}'), '[\\p{{L}}\\p{{N}}_]+')) AS asked) SELECT f.doc_id, len(list_intersect({_WORDS}, asked))::INT AS shared, (len(asked) - len(list_intersect({_WORDS}, asked)))::INT AS missing FROM f JOIN documents d ON d.doc_id = f.doc_id, q",
}
