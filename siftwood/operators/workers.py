"""Python workers that have this package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_shipped: set[str] = set()
_kept: dict[str, Any] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="siftwood-"), "siftwood.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


#: Bytes of an Arrow batch, where the session has Spark's default: a worker holds a batch and what it makes of it.
BATCH_BYTES, _SETTING, _DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def hand_back() -> None:
    """Give the memory that this process holds but does not use back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What make() gives, made once a worker and kept for its tasks that name it; see map_arrow."""
    if name not in _kept:
        _kept[name] = make()
        hand_back()
    return _kept[name]


def drop_kept(but: str | None = None) -> None:
    """Let go of what tasks of other stages kept in this worker."""
    for name in [n for n in _kept if n != but]:
        del _kept[name]


def map_arrow(df: DataFrame, fn, schema: StructType | str, keeps: str | None = None) -> DataFrame:
    """df.mapInArrow, on executors that have this package and in batches of bounded size.

    Workers are used again by the stages that follow, so each task ends with handing memory
    back, and begins by letting go of all that was `kept` but for what it `keeps` itself.
    """
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_SETTING) == _DEFAULT:
        spark.conf.set(_SETTING, str(BATCH_BYTES))

    def run(batches):
        drop_kept(keeps)
        yield from fn(batches)
        hand_back()

    return df.mapInArrow(run, schema)
