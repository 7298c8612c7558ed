"""A corpus in five stages: language, lines, near copies, mixture, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents that the next one reads.  All but the last return the columns of documents, in
their order; columns beyond those pass through, whatever their names.  Every stage takes an
empty table, texts of any length, rows that repeat, and nulls in any column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.llm import common, op1_bpe, op6_mixing, op7_simhash, op9_lines, op10_language

#: Of 2500 held-out labelled documents of sf0.1, 2 are mixed or score below these, and none has under 0.96 of its features known;
#: text of two languages in turn is mixed to 0.43 to 0.5, letter junk and a language not learned are known to 0.37 at most.
MOST_MIXED, LEAST_OVER_CHANCE, LEAST_KNOWN = 0.42, 0.2, 0.6


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language, with lang filled in where it was null.

    The CRF is fitted on a bounded sample of the documents' own labels.  Documents without a
    letter go (null and empty texts among them), those evenly mixed of languages, those of
    which no language is likelier than chance by LEAST_OVER_CHANCE, and those of words unlike
    all that was learned; if no document is labelled, all go.  Rows are judged one by one, so
    repeats are alike.
    """
    model = op10_language.fit_languages(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    chance = 1 / max(1, len(model.langs))
    seen = op10_language.with_language(docs, model, measures=True, boxed=True).filter(F.col("lang_pred") != "und")
    seen = seen.filter((F.col("mixed") <= MOST_MIXED) & (F.col("score") >= chance + LEAST_OVER_CHANCE * (1 - chance)) & (F.col("known") >= LEAST_KNOWN))
    filled = F.coalesce("own.lang", "lang_pred").alias("lang")
    return seen.select(*[filled if c == "lang" else F.col(f"own.`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, or are an edit away from it, however short.

    n_chars is that of the new text.  A document left without a word by that goes; one that
    had no word before stays, as do rows with a null doc_id, whose lines are not compared.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = op9_lines.dedup_lines(docs, keep=rest, every=True, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of texts whose five-word shingles are 0.8 similar or more.

    SimHash and BK-trees give the first links, each verified on the whole sets; shards of
    shingles add those beyond its three bits, so no link is lost.
    Rows that share a doc_id are judged by their texts; one stays of those alike in both.
    Rows with a null doc_id stay.  Texts without words are alike.
    """
    return op7_simhash.drop_near_copies(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their temperature weights; none more than twice, none dropped.

    A null source is a source of its own; a source without tokens is left as it is; rows that share a doc_id are
    repeated alike.
    """
    mixed = op6_mixing.mix_sources(docs, boxed=True)
    return mixed.select("own", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select("own.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each row; a null text is empty."""
    return op1_bpe.encode_texts(docs, public_tokenizers.path(op1_bpe.VOCABULARY), ("ids", "decoded_sha256"))


STAGES = [("language", language), ("line dedup", lines), ("near copies", near_copies), ("mixture", mixture), ("tokens", tokens)]
#: SQL can express neither the language model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table documents, each to the Parquet the one before has written, which is then deleted."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            common.release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
