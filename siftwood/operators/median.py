"""Exact medians of groups of any size: equal values are counted first, then ranges of values, then one range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise


def medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(*keys, *values): the mean of the middle two of each column's non-null values a group, as percentile(x, 0.5) gives it.

    Equal values become one row with a count, before and after the shuffle.  The counted values
    are dealt out by ranges; only the range in which a group's middle lies is put in order.  So
    no buffer grows with a group or its distinct values: a task holds one range, sorted by
    Spark.  NaN is the largest value; groups without values are left out; null keys are a group.
    """
    item = F.explode(F.array(*[F.struct(F.lit(name).alias("of"), c.cast("double").alias("v")) for name, c in values.items()])).alias("_item")
    groups = [*keys, "_of"]
    counted = df.select(*keys, item).select(*keys, F.col("_item.of").alias("_of"), F.col("_item.v").alias("_v")).filter("_v IS NOT NULL").groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    dealt = materialise(counted.repartitionByRange(*groups, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    # a row for each range that a group has values in: the ranges and the groups together at most
    of_range = dealt.groupBy(*groups, "_part").agg(F.sum("_n").alias("_held"))
    whole = Window.partitionBy(*groups)
    placed = of_range.withColumn("_upto", F.sum("_held").over(whole.orderBy("_part"))).withColumn("_total", F.sum("_held").over(whole))
    low, high, before = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2), F.col("_upto") - F.col("_held")
    middle = placed.filter((before <= high) & (F.col("_upto") > low))
    named = middle.select(*[F.col(c).alias(f"_own_{c}") for c in (*groups, "_part")], before.alias("_before"), low.alias("_low"), high.alias("_high"))
    inside = dealt.join(named, [F.col(c).eqNullSafe(F.col(f"_own_{c}")) for c in (*groups, "_part")])
    seen = inside.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*groups, "_part").orderBy("_v")))
    at = lambda k: F.min(F.when(F.col("_upto") > F.col(k), F.col("_v")))
    found = seen.groupBy(*groups).agg((at("_low") * 0.5 + at("_high") * 0.5).alias("_median"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == name, F.col("_median"))).alias(name) for name in values])
