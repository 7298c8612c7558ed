"""Operator 10: language identification by a linear-chain conditional random field."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .crf import Crf, fit

#: Fitting reads about this many labelled rows, spread evenly over the languages; one a language if there are more languages.
SAMPLE_ROWS = 1600
#: Of a longer text, fitting reads a stretch of so many characters, from a place that its hash names.
SAMPLE_CHARS = 40_000
#: Languages up to which their table is broadcast to the texts; beyond, the two are joined by shuffle.
BROADCAST_LANGS = 50_000
BATCH_CHARS = 1_500_000


def fold(id_col: str = "doc_id"):
    """The remainder of a document's fold, from its id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit_languages(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Crf:
    """Fit on a bounded sample of labelled (key, text, lang); rows with a null in text or lang are left out.

    Which rows are taken depends on a hash of the key alone.  Counts per language come from
    all rows, so that each language gets its share of the bound, and one row at least.  The
    driver gets 2 * sample_rows texts, and one a language, of SAMPLE_CHARS characters at most.
    """
    labelled = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = common.materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    langs = counts.count()
    if not langs:
        return fit([])
    small = F.broadcast if langs <= BROADCAST_LANGS else lambda df: df
    rates = small(counts.select("lang", F.least(F.lit(1.0), F.lit(sample_rows / langs) / F.col("n")).alias("rate")))
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    at = (draw / F.col("rate")).alias("at")
    # a language's lowest draw is taken in any case, the others while they are within its rate
    first = labelled.join(rates, "lang").select("lang", at).groupBy("lang").agg(F.min("at").alias("first"))
    first = small(common.materialise(first, "language-first"))
    # the hash names one of the stretches that a text is cut into
    stretches = F.ceil(F.length("text") / SAMPLE_CHARS).cast("int")
    stretch = F.when(stretches > 1, F.substr("text", (F.pmod(F.xxhash64("text"), stretches) * SAMPLE_CHARS + 1).cast("int"), F.lit(SAMPLE_CHARS))).otherwise(F.col("text"))
    drawn = labelled.join(rates, "lang").select("key", "lang", stretch.alias("text"), at)
    order = ["at", F.xxhash64("text"), "lang", "text"]
    # of rows that share the lowest draw one is enough: no task gets all rows of a language
    least = drawn.join(first, "lang").filter(F.col("at") == F.col("first")).groupBy("lang").agg(F.min_by(F.struct("key", "text"), F.struct(*order[1:])).alias("r")).select("r.key", "lang", "r.text")
    more = drawn.filter("at < 1").orderBy(*order).limit(2 * sample_rows)
    rows = more.select("key", "lang", "text").union(least).distinct().collect()
    return fit([(r.lang, r.text) for r in sorted(rows, key=lambda r: (str(r.key), r.lang, r.text))])


def predict_languages(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, mixed) of whole texts; only the text is an input.

    score is the mean marginal probability of lang_pred over the words, mixed the share of
    words labelled with another language.  A text that is null, empty or without a letter is
    `und` with score 0, as is every text if nothing could be learned.  Rows are independent:
    repeated rows and null ids pass through one to one; other columns are not read.  The
    model, bounded by its number of features, is broadcast.
    """
    payload = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            crf = payload.value
            while at < len(texts):
                end, room = at, BATCH_CHARS
                while end < len(texts) and room > 0:
                    room -= len(texts[end] or "")
                    end += 1
                got = crf.predict(texts[at:end])
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                    [id_col, "lang_pred", "score", "n_words", "mixed"],
                )
                at = end

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(narrow, run, f"`{id_col}` long, lang_pred string, score double, n_words long, mixed double")


def with_language(docs: DataFrame, model: Crf, text_col: str = "text", measures: bool = False, boxed: bool = False) -> DataFrame:
    """docs as they are, with lang_pred and score added, and with measures also mixed and known; no shuffle.

    known is the mean, over the words, of the share of a word's features that fitting saw.
    Columns of docs of those names are replaced; boxed, all columns of docs stay, in one
    struct `own`.  Nulls, repeats and empty tables as in predict_languages.
    """
    added = {"lang_pred": "string", "score": "double"} | ({"mixed": "double", "known": "double"} if measures else {})
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    at_text = docs.columns.index(text_col)
    payload = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            own, at = batch.column(0), 0
            texts = own.field(at_text).to_pylist()
            while at < len(texts):
                end, room = at, BATCH_CHARS
                while end < len(texts) and room > 0:
                    room -= len(texts[end] or "")
                    end += 1
                lang, score, _, mixed, known = zip(*payload.value.judge(texts[at:end]), strict=True)
                cols = [pa.array(lang, pa.string()), *[pa.array(x, pa.float64()) for x in (score, mixed, known)]][: len(added)]
                yield pa.RecordBatch.from_arrays([own.slice(at, end - at), *cols], ["own", *added])
                at = end

    schema = whole.schema.simpleString()[len("struct<own:") : -1]
    out = common.map_arrow(whole, run, f"own {schema}, " + ", ".join(f"{c} {kind}" for c, kind in added.items()))
    return out if boxed else out.select(*[F.col(f"own.`{c}`") for c in docs.columns if c not in added], *added)


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit_languages(docs.filter(fold() != 2).select(F.col("doc_id").alias("key"), "text", "lang"))
    held_out = F.coalesce(fold() == 2, F.lit(False)).alias("held_out")
    return predict_languages(docs, model).select("doc_id", held_out, "lang_pred", "score", "n_words", "mixed")
