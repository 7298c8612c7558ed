"""Sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def result_json(results: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, results): the results of each query as a JSON array, best first; missing pages and notes are left out."""
    fields = [c for c in results.columns if c not in (by, "place")]
    one = F.struct("place", F.to_json(F.struct(*fields)).alias("j"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["j"]), ",")
    return results.groupBy(by).agg(F.concat(F.lit("["), joined, F.lit("]")).alias("results"))


def print_results(rows: list[Row]) -> str:
    """Collected results of one query as text."""
    blocks = []
    for r in rows:
        where = f"page {r.page}" if r.page is not None else f"{r.line_start}-{r.line_end}"
        body = "\n".join("  " + x for x in r.snippet.splitlines())
        blocks.append(f"{r.path}:{where}\n{body}" + (f"\n  [note] {r.note}" if r.note else ""))
    return "\n\n".join(blocks) or "no results"
