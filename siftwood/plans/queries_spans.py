"""Registered queries over spans of whole documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.operators import intervals
from siftwood.operators.scratch import materialise

from .queries_retrieval import read

#: Words of a window and from one to the next; sizes of the chunks that a sentence is looked up in; what ends a sentence.
WINDOW, STEP, SIZES, SENTENCE_END = 48, 32, (16, 64, 256), r"[.!?]\z"
#: Blocks of 64 words, and of 1,024 for long chunks.
GRIDS = (6, 10)
_WORDS = r"[^\x20\x09-\x0D]+"


def _words(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n, ends) of documents with a word: the number of words and the places of those that end a sentence, the last one among them.

    Texts are cut once: the joins read their sides several times, and each time would cut them again.
    """
    words = read(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(_WORDS), 0).alias("w")).filter(F.size("w") > 0)
    last = F.size("w") - 1
    ends = F.filter(F.transform("w", lambda w, i: F.when(w.rlike(SENTENCE_END) | (i == last), i)), lambda i: i.isNotNull())
    return materialise(words.select("doc_id", F.size("w").alias("n"), ends.alias("ends")), "sentences")


def _span_rows(words: DataFrame, spans: Column) -> DataFrame:
    return words.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.lo", "s.hi")


def _span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def _sentences(words: DataFrame) -> DataFrame:
    """(doc_id, lo, hi): words of each sentence; what follows the last end is one too."""
    begins = F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1))
    return _span_rows(words, F.zip_with("ends", F.slice(begins, 1, F.size("ends")), lambda e, b: _span(b, e)))


def _tiles(size: int, step: int) -> Column:
    n = F.col("n")
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: _span(s, F.least(s + (size - 1), n - 1)))


def window_sentences(spark, d):
    """For each overlapping window of words: the sentences it meets, those it holds whole, and the words they share."""
    words = _words(spark, d)
    met = intervals.overlaps(_span_rows(words, _tiles(WINDOW, STEP)), _sentences(words), ["doc_id"], grids=GRIDS[:1])
    low, high = F.greatest("left.lo", "right.lo"), F.least("left.hi", "right.hi")
    whole = (F.col("right.lo") >= F.col("left.lo")) & (F.col("right.hi") <= F.col("left.hi"))
    return met.groupBy("left.doc_id", "left.lo", "left.hi").agg(F.count(F.lit(1)).alias("met"), F.count_if(whole).alias("whole"), F.sum(high - low + 1).alias("shared"))


def sentence_chunks(spark, d):
    """The smallest chunk, of three sizes or the whole text, that holds each sentence whole."""
    words = _words(spark, d)
    chunks = _span_rows(words, F.concat(F.array(_span(F.lit(0), F.col("n") - 1)), *[_tiles(size, size // 2) for size in SIZES]))
    return intervals.innermost(_sentences(words), chunks, ["doc_id"], grids=GRIDS).select("doc_id", "lo", "hi", F.col("outer_lo").alias("chunk_lo"), F.col("outer_hi").alias("chunk_hi"))


QUERIES = {f.__name__: f for f in (window_sentences, sentence_chunks)}

# ---- SQL ---------------------------------------------------------------------------------

_SENTENCES = rf"""w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS a FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, len(a) AS n FROM w WHERE len(a) > 0),
e AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS i FROM w), t AS (SELECT doc_id, i AS hi FROM e JOIN n USING (doc_id) WHERE i = n - 1 OR regexp_matches(word, '[.!?]\z')),
s AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY hi) + 1, 0) AS lo, hi FROM t)"""


def _sql_tiles(size: int, step: int) -> str:
    return f"SELECT doc_id, lo, least(lo + {size - 1}, n - 1) AS hi FROM (SELECT doc_id, n, unnest(range(0, n, {step})) AS lo FROM n)"


ORACLES = {
    "window_sentences": f"""WITH {_SENTENCES}, c AS ({_sql_tiles(WINDOW, STEP)})
        SELECT doc_id, c.lo AS lo, c.hi AS hi, count(*) AS met, count_if(s.lo >= c.lo AND s.hi <= c.hi)::BIGINT AS whole, sum(least(s.hi, c.hi) - greatest(s.lo, c.lo) + 1)::BIGINT AS shared
        FROM c JOIN s USING (doc_id) WHERE s.lo <= c.hi AND s.hi >= c.lo GROUP BY ALL""",
    "sentence_chunks": f"""WITH {_SENTENCES}, c AS (SELECT doc_id, 0 AS lo, n - 1 AS hi FROM n UNION ALL {" UNION ALL ".join(_sql_tiles(k, k // 2) for k in SIZES)})
        SELECT doc_id, s.lo AS lo, s.hi AS hi, c.lo AS chunk_lo, c.hi AS chunk_hi FROM s JOIN c USING (doc_id) WHERE c.lo <= s.lo AND c.hi >= s.hi
        QUALIFY row_number() OVER (PARTITION BY doc_id, s.lo ORDER BY c.hi - c.lo, c.lo) = 1""",
}
