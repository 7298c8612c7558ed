"""Token counts of the text columns of a frame, by counters that workers keep."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from siftwood.functions.tokens import PATTERN, Counter, read_ranks

from .workers import kept, map_arrow


def count_columns(df: DataFrame, names: list[str], path: str | Path, pattern: str = PATTERN) -> DataFrame:
    """df with the text columns of these names turned into their counts (long), as functions.tokens.token_counter gives them.

    One pass of a worker counts all of them, and the worker keeps the words that it knows for
    its further tasks, which a function of a column does not.
    """
    data = Path(path).read_bytes()
    name = f"tokens {hashlib.sha1(data + pattern.encode()).hexdigest()}"
    schema = StructType([StructField(f.name, LongType()) if f.name in names else f for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(name, lambda: Counter(read_ranks(data), pattern))
        for batch in batches:
            columns = [pa.array(counter.counts(c.to_pylist()), pa.int64()) if n in names else c for n, c in zip(schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(df, run, schema, name)
