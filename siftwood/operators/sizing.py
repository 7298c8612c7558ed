"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side (queries, query terms, a dimension) is broadcast.
MAX_ROWS = 100_000


def is_small(df: DataFrame, max_rows: int = MAX_ROWS) -> bool:
    """Whether df has at most max_rows rows; reads no more than one beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS, known_by: DataFrame | None = None, per_row: int = 1) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows; else as it is, for a shuffle join.

    known_by is a cheaper frame that bounds df: df has at most per_row rows for each of its.
    """
    small = is_small(df, max_rows) if known_by is None else is_small(known_by, max_rows // per_row)
    return F.broadcast(df) if small else df
