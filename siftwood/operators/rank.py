"""Fusion of rankings, re-weighting, top-k and the shape of results.

Ranks stay on narrow rows; the wide chunk text is joined to the at most 2 x CANDIDATES fused
rows of each query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import outline as outlines
from siftwood.functions.text import definition_pattern, is_prose_path, is_test_path, symbol_names, wants_docs, wants_tests

from .lexical import CANDIDATES

# The fusion constant, the weights of rankings, and the path factors.
RRF_K, STATIC_WEIGHT, MODEL_WEIGHT, KEYWORD_WEIGHT = 60, 0.6, 1.0, 1.0
TEST_FACTOR, PROSE_FACTOR = 0.8, 0.8


def clamp_k(top_k: int) -> int:
    return max(1, min(int(top_k), CANDIDATES))


def fuse_all(rankings: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """(query_id, chunk_id, <name>.., score) of any number of weighted rankings (name, (query_id, chunk_id, rank), weight).

    A union and one grouping, no join of the rankings with each other; the parts are added in
    the order given.  A ranking that has a chunk twice counts its better rank.
    """
    sides = [r.select("query_id", "chunk_id", *[(F.col("rank") if n == name else F.lit(None)).cast("int").alias(n) for n, _, _ in rankings]) for name, r, _ in rankings]
    ranks = reduce(DataFrame.unionAll, sides).groupBy("query_id", "chunk_id").agg(*[F.min(n).alias(n) for n, _, _ in rankings])
    parts = [F.coalesce(F.lit(weight) / (RRF_K + F.col(n)), F.lit(0.0)) for n, _, weight in rankings]
    return ranks.withColumn("score", reduce(Column.__add__, parts))


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = STATIC_WEIGHT) -> DataFrame:
    """(query_id, chunk_id, vec_rank, kw_rank, score) of a vector and a keyword ranking (query_id, chunk_id, rank)."""
    return fuse_all([("vec_rank", vector, vector_weight), ("kw_rank", keyword, KEYWORD_WEIGHT)])


def reweigh(score: Column, query: Column, path: Column, text: Column) -> Column:
    """Definition boost for a chunk that defines a name in the query, then test and prose factors."""
    pattern = definition_pattern(symbol_names(query))
    score = score + F.when(F.coalesce(F.rlike(text, pattern), F.lit(False)), 1.0 / (RRF_K + 1)).otherwise(0.0)
    score = score * F.when(~wants_tests(query) & is_test_path(path), TEST_FACTOR).otherwise(1.0)
    return score * F.when(~wants_docs(query) & is_prose_path(path), PROSE_FACTOR).otherwise(1.0)


def best(fused: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with place; ties go to the vector ranking by rank, then the keyword ranking."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce(F.col("vec_rank"), F.col("kw_rank") + CANDIDATES))
    return fused.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= clamp_k(k))


# Fixed value: what the note of a chunk with images says, by what the chunk is.
IMAGE_NOTE = "this {} also contains {} image(s) not indexed — open the source file directly if visual content is needed"


def note(kind: Column, images: Column) -> Column:
    where = F.when(kind == "pdf_page", "page").otherwise("section")
    return F.when(images > 0, F.format_string(IMAGE_NOTE.replace("{}", "%s"), where, images))


def shape(rows: DataFrame, detail: str = "full") -> DataFrame:
    """Result rows from rows with query, score and the chunk's columns."""
    if detail not in ("full", "outline"):
        raise ValueError("detail must be 'full' or 'outline'")
    snippet = F.col("text") if detail == "full" else outlines.outline(F.col("text"), F.col("kind"), F.col("query"))
    return rows.select(
        "query_id", "place", "path", "line_start", "line_end", snippet.alias("snippet"), F.round("score", 4).alias("score"), "kind",
        F.when(F.col("kind") == "pdf_page", F.col("line_start")).alias("page"), note(F.col("kind"), F.col("images")).alias("note"),
    )


def format_text(results: DataFrame) -> DataFrame:
    """(query_id, report): the results of each query as text, best first."""
    where = F.when(F.col("page").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string"))).otherwise(F.concat(F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")))
    body = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace("snippet", r"\n\z", ""), "\n", "\n  "))
    tail = F.coalesce(F.concat(F.lit("\n  [note] "), F.col("note")), F.lit(""))
    block = results.select("query_id", F.struct("place", F.concat("path", F.lit(":"), where, F.lit("\n"), body, tail).alias("t")).alias("b"))
    return block.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["t"]), "\n\n").alias("report"))
