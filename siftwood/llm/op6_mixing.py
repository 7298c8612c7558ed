"""Operator 6: mixing sources to target weights by temperature.

A source's weight is its token share to the power alpha, normalised.  The exponent between 0
(all sources alike) and 1 (as they come) is bisected, sixteen values to a pass, until the
weights meet a target entropy, or the flattest weights that keep within a repetition limit.
The weights are then realised as a budget of tokens per source: whole passes over the source,
and for the rest a prefix of a permutation of its documents, ordered by a keyed hash and cut
into blocks.  Blocks are summed first and only the block in which the budget ends is looked
at row by row, so a source with a third of all rows is never sorted in one place.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: No document is repeated more than this many times; permutation seed; tokens of a block, and most blocks of a source.
REPETITION, SEED, BLOCK_TOKENS, MOST_BLOCKS = 2.0, "mix-1", 1 << 20, 1 << 16
#: Up to so many sources their table is broadcast to the documents; beyond, the two are joined by shuffle.
BROADCAST_SOURCES = 50_000
_WIDTH, _ROUNDS = 16, 9


def token_estimate(text):
    """A token per four bytes of UTF-8, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def source_key(source):
    """A key that keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def shuffled_at(doc_id):
    """A document's place in the permutation: a keyed hash as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def find_exponent(shares: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None) -> float:
    """The least alpha in [0, 1] with entropy (in nats) or greatest repetition at or below its target.

    Both fall as alpha rises.  Repetition is counted for the budget that uses the fullest
    source once: the greatest ratio of weight to share over the least.  If alpha 1 misses the
    target, it is 1.
    """
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    low, high = 0.0, 1.0
    p = F.col("share")
    for _ in range(_ROUNDS):
        tried = [low + (high - low) * k / _WIDTH for k in range(_WIDTH + 1)]
        sums = []
        for k, a in enumerate(tried):
            if entropy is None:
                ratio = F.pow(p, F.lit(a - 1.0))
                sums.append((F.max(ratio) / F.min(ratio)).alias(f"v{k}"))
            else:
                z = F.sum(F.pow(p, F.lit(a)))
                sums.append((F.log(z) - F.lit(a) * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / z).alias(f"v{k}"))
        got = shares.agg(*sums).first()
        bound = repetition if entropy is None else entropy
        met = [k for k in range(_WIDTH + 1) if got[k] is not None and got[k] <= bound]
        k = met[0] if met else _WIDTH
        if k == 0 or not met:
            return tried[k]
        low, high = tried[k - 1], tried[k]
    return high


def mix_sources(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", boxed: bool = False) -> DataFrame:
    """docs with the columns mix_tokens, mix_weight and mix_copies added.

    Columns of docs of those names are replaced; boxed, all columns of docs stay, in one
    struct `own`.

    mix_copies is how often a document is used.  budget is the tokens of the mixture; by
    default the least that uses every document, so nothing is dropped and small sources are
    repeated.  A null source is a source of its own; a null or empty text has no tokens; a
    source without tokens has weight 0 and each of its documents one copy.  Rows that share
    an id are used alike.  An empty table gives an empty result.
    """
    key, tokens, at = source_key(F.col(source_col)), token_estimate(F.col(text_col)), shuffled_at(F.col(id_col))
    rows = docs.select(key.alias("key"), tokens.alias("tokens"), at.alias("at"))
    totals = rows.groupBy("key").agg(F.sum("tokens").alias("total"))
    totals = common.materialise(totals, "mix-totals")
    every, n_sources = totals.agg(F.sum("total"), F.count(F.lit(1))).first()
    shares = totals.withColumn("share", F.col("total") / F.lit(float(every or 1)))
    some = shares.filter("total > 0")
    alpha = find_exponent(some, repetition, entropy)
    z, least = some.agg(F.sum(F.pow("share", F.lit(alpha))), F.min(F.pow("share", F.lit(alpha - 1.0)))).first()
    weight = F.when(F.col("total") > 0, F.pow("share", F.lit(alpha)) / F.lit(z or 1.0)).otherwise(0.0)
    scale = F.lit(1.0 / (least or 1.0)) if budget is None else F.lit(budget / ((every or 1) * (z or 1.0)))
    target = F.floor(F.pow("share", F.lit(alpha - 1.0)) * scale * F.col("total") + 0.5).cast("long")
    plan = shares.withColumn("weight", weight).withColumn("target", F.when(F.col("total") > 0, target).otherwise(0))
    plan = plan.withColumn("whole", F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(1).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("total") > 0, F.col("target") - F.col("whole") * F.col("total")).otherwise(0))
    plan = plan.withColumn("blocks", F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_TOKENS))).cast("long"))
    plan = common.materialise(plan.select("key", "weight", "whole", "rest", "blocks"), "mix-plan")
    small = n_sources <= BROADCAST_SOURCES

    def with_plan(df: DataFrame, side: DataFrame) -> DataFrame:
        return df.join(F.broadcast(side) if small else side, "key", "left")

    # the block in which each source's rest ends, and the tokens before it
    block = F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * F.col("blocks") / F.lit(float(1 << 32))).cast("long")
    placed = with_plan(rows, plan).withColumn("block", block)
    sums = placed.groupBy("key", "block", "rest").agg(F.sum("tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy("key").orderBy("block"))
    crossing = sums.withColumn("upto", run).filter("upto > rest").groupBy("key", "rest").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
    crossing = common.materialise(crossing.select("key", F.col("rest").alias("goal"), F.col("b.block").alias("last"), "b.before"), "mix-crossing")
    inside = placed.join(F.broadcast(crossing) if small else crossing, "key").filter("block = last")
    inside = inside.groupBy("key", "at", "goal", "before").agg(F.sum("tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy("key").orderBy("at"))
    cut = inside.withColumn("upto", F.col("before") + run).filter("upto <= goal").groupBy("key").agg(F.max("at").alias("cut"))
    final = common.materialise(plan.join(crossing.select("key", "last"), "key", "left").join(cut, "key", "left"), "mix-final")

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")  # apart from the names used here
    named = docs.select(own, tokens.alias("mix_tokens"), key.alias("key"), at.alias("at"))
    extra = F.col("last").isNull() | (block < F.col("last")) | ((block == F.col("last")) & (F.col("at") <= F.col("cut")))
    copies = F.col("whole") + F.when((F.col("rest") > 0) & F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    added = {"mix_tokens": F.col("mix_tokens"), "mix_weight": F.col("weight"), "mix_copies": copies.cast("long")}
    mine = [F.col("own")] if boxed else [F.col(f"own.`{c}`") for c in docs.columns if c not in added]
    return with_plan(named, final).select(*mine, *[c.alias(name) for name, c in added.items()])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 9).alias("weight"), F.col("mix_copies").alias("copies"))


#: The exponent in closed form: the ratio of the smallest source to the largest is just at the limit.
ORACLE = """
WITH d AS (SELECT doc_id, source, ((strlen(coalesce(text, '')) + 3) // 4)::BIGINT AS n, md5(concat('mix-1:', doc_id)) AS at_hash FROM documents),
t AS (SELECT source, sum(n)::BIGINT AS total, sum(n) / (SELECT sum(n) FROM d)::DOUBLE AS p FROM d GROUP BY source),
a AS (SELECT greatest(0.0, 1 - ln(2.0) / greatest(ln(max(p) / min(p)), 1e-300)) AS alpha, max(p) AS top FROM t),
q AS (SELECT source, total, pow(p, alpha) / sum(pow(p, alpha)) OVER () AS weight, floor(pow(p / top, alpha - 1) * total + 0.5)::BIGINT AS target FROM t, a),
r AS (SELECT d.*, weight, target // total AS whole, target % total AS rest, sum(n) OVER (PARTITION BY d.source ORDER BY at_hash) AS upto FROM d JOIN q USING (source))
SELECT doc_id, source, n AS n_tokens, round(weight, 9) AS weight, (whole + (upto <= rest)::INT)::BIGINT AS copies FROM r
"""
