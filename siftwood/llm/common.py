"""Helpers shared by the training-data operators: inputs, shared scratch tables, joins with hot keys, workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.operators.scratch import materialise, release, scratch_path, shared_dir
from siftwood.operators.workers import kept, map_arrow, ship_package

__all__ = ["hot_keys", "join_unique", "kept", "key_filter", "map_arrow", "materialise", "release", "scratch_path", "shared_dir", "ship_package", "table", "with_filter"]

#: A key is hot that has one in so many of all rows; there are no more hot keys than this, so they can be broadcast.
#: Keys of fewer rows than LEAST_HOT are not, whatever their share.
HOT_KEYS, LEAST_HOT = 1000, 10_000
#: A filter of keys: buckets of so many bits, as bitmap_construct_agg makes them; 8 MB in all, whatever the number of keys.
FILTER_BUCKETS, BUCKET_BITS = 2048, 32768
#: DuckDB SQL for the CRC-32 of an ASCII string {0}.
CRC32_SQL = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))))"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; read by Spark, so any store Spark can reach will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(counts: DataFrame, count: str = "n") -> DataFrame | None:
    """The hot ones of keys with their counts of rows, without the counts: at most HOT_KEYS; None if there is none."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    hot = counts.filter((F.col(count) >= LEAST_HOT) & (F.col(count) * HOT_KEYS > F.lit(total))).drop(count)
    rows = hot.collect()
    if not rows:
        return None
    # as literals: a frame made of local rows would start Python workers of their own on the executors
    named = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, hot.schema, strict=True)]) for r in rows]
    return counts.sparkSession.range(1).select(F.inline(F.array(*named)))


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """The inner or left join of left with right, which has one row a key, hot ones too; left's rows of hot keys stay where they are.

    The rows of right that hot keys name are broadcast, HOT_KEYS at most, so a key with a
    third of all rows is in no task's share; the rest is a shuffle join.
    """
    if hot is None:
        return left.join(right, keys, how)
    named = F.broadcast(hot)
    stay = left.join(F.broadcast(right.join(named, keys, "left_semi")), keys)
    return stay.unionByName(left.join(named, keys, "left_anti").join(right.join(named, keys, "left_anti"), keys, how))


def key_filter(keys: DataFrame) -> DataFrame:
    """A filter (bucket, bits) of keys (h long): a Bloom filter of one bit a key, of bounded size."""
    at = F.pmod("h", F.lit(FILTER_BUCKETS * BUCKET_BITS))
    placed = keys.select(F.floor(at / BUCKET_BITS).cast("int").alias("bucket"), F.pmod(at, F.lit(BUCKET_BITS)).alias("at"))
    # by bucket first, as long as a key is 8 bytes; the maps of all buckets from every task would be more
    return materialise(placed.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "filter")


def with_filter(df: DataFrame, keys: DataFrame, h, name: str) -> DataFrame:
    """df with the column name: whether the filter may hold the key h; false is certain."""
    at = F.pmod(h, F.lit(FILTER_BUCKETS * BUCKET_BITS))
    joined = df.withColumn("_at", at).withColumn("bucket", F.floor(F.col("_at") / BUCKET_BITS).cast("int")).join(F.broadcast(keys), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.pmod("_at", F.lit(BUCKET_BITS)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, F.pmod("_at", F.lit(8)).cast("int")) == 1, F.lit(False))).drop("bucket", "bits", "_at")
