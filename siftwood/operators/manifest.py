"""Incremental maintenance: differences of file manifests and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed(known: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of current (path, mtime, size) that are new or whose signature differs."""
    old = known.select("path", F.struct("mtime", "size").alias("old"))
    joined = current.withColumn("new", F.struct("mtime", "size")).join(old, "path", "left")
    return joined.filter(~F.col("new").eqNullSafe(F.col("old"))).select("path")


def removed(known: DataFrame, current: DataFrame) -> DataFrame:
    return known.join(current, "path", "left_anti").select("path")


def apply_delta(rows: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """rows without those of the gone paths, and the new rows."""
    return rows.join(gone.select("path").distinct(), "path", "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of both, new ones in place of old ones of the same key."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    latest = F.row_number().over(Window.partitionBy(key).orderBy("_age"))
    return both.withColumn("_n", latest).filter("_n = 1").drop("_n", "_age")
