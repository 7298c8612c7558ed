"""A stream of file versions applied to an index.

A file stream never reads a changed path again, so the input here is a log: each row is a
version of a file (path, mtime, size, text, deleted).  Every micro-batch is reduced to the
newest version of each path and applied as one delta; applying it twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftwood.plans.engine import Engine
from siftwood.sources.corpus import latest

from .newest import newest_versions

SCHEMA = "path string, mtime double, size long, text string, deleted boolean"


def follow(versions: DataFrame, engine: Engine, checkpoint: str, once: bool = True, grace: float | None = None) -> StreamingQuery:
    """Keep an engine's index in step with a stream of versions; with once, what there is now.

    With grace, seconds that a deletion waits for a newer version, the newest version of each
    path is kept as state (`newest`), and what is not newer never reaches the index.
    """
    if grace is not None:
        versions = newest_versions(versions, grace)

    def apply(batch: DataFrame, _: int) -> None:
        newest = latest(batch).persist()
        if newest.limit(1).count():
            engine.apply(newest)
        newest.unpersist()

    writer = versions.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
