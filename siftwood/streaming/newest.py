"""The newest version of every path of a stream, as state.

The input is the log of file versions of `versions`.  For each path the state holds the time
of its newest version, so a version that comes late, twice or out of order goes no further,
over restarts too, and without a look at the index.  A deletion is held back for a while: files
that are replaced are often deleted first, and a version that comes meanwhile takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siftwood.operators.workers import ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "path string, mtime double, size long, text string, deleted boolean"


class NewestVersion(StatefulProcessor):
    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "mtime double")

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at if isinstance(at, int) else at[0])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.known.get() if self.known.exists() else None
        newest = None
        for r in rows:
            if r.mtime is None or (held and r.mtime <= held[0]):
                continue
            # of equal times what is there wins over a deletion, then the larger, so that order of arrival doesn't matter
            rank = (r.mtime, not r.deleted, -1 if r.size is None else r.size, r.text or "")
            if newest is None or rank > newest[0]:
                newest = (rank, r)
        if newest is None:
            return
        version = newest[1]
        self.known.update((version.mtime,))
        self._forget_timers()
        if not version.deleted:
            yield Row(path=version.path, mtime=version.mtime, size=version.size, text=version.text, deleted=False)
        else:
            self.handle.registerTimer(version.now + self.grace_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(path=key[0], mtime=self.known.get()[0], size=None, text=None, deleted=True)


def newest_versions(versions: DataFrame, grace: float = 60.0) -> DataFrame:
    """The versions (path, mtime, size, text, deleted) of a stream that are newer than all before of their path.

    Time is that of arrival, as late versions have old times of their own: a deletion comes out
    after the first batch that arrives over grace seconds later, unless a newer version has
    come by then.  Of versions of one time and batch, one is taken whatever their order; a
    null `deleted` is none, and rows without a path or time are left out.  State grows with
    the paths, by a number each; it needs the RocksDB provider.
    """
    spark = versions.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    ship_package(spark)
    named = versions.filter("path IS NOT NULL AND mtime IS NOT NULL").selectExpr("path", "mtime", "size", "text", "coalesce(deleted, false) AS deleted", "current_timestamp() AS arrived", "unix_millis(current_timestamp()) AS now")
    named = named.withWatermark("arrived", "0 seconds")
    return named.groupBy("path").transformWithState(NewestVersion(int(grace * 1000)), SCHEMA, "Update", "EventTime")
