"""An inverted index of segments that merge, with snapshots for readers and a vacuum.

An update writes one segment: its chunks, the postings of these, the files it touches, and what
it takes from older segments - the ids of their chunks that are dead now, and the document
frequencies of those.  A row of an older segment is live if no younger one names its id dead.
Segments are merged from the youngest on, by size, so there is only a handful; merging drops the
dead rows.  One state file names the segments and the totals of the live chunks; it is replaced
as a whole, so readers see all of an update or nothing.

Postings lie in the order of their terms, in blocks: the postings of a term whose ids fall in one
range of ids, with the largest tf and the least dl among them.  A search has its terms as literals
of the scan, which skips the other row groups; the bounds of the blocks tell which ranges can hold
one of the k best, and the others are not read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwood.functions.text import index_tokens
from siftwood.sources import store

from . import lexical
from .lexical import B, CANDIDATES, K1, LEAST_IDF, LITERAL_TERMS, POINT, LexicalIndex, dealt_for, terms_of_queries, top_ranked
from .scratch import delete, materialise, release
from .sizing import MAX_ROWS, broadcast_if_small, is_small

#: A segment is merged with the younger ones if these have a FANOUT-th of its size or more; segments beyond which that is done.
FANOUT, MOST_SEGMENTS = 6, 6
#: Chunks of a range of ids, tokens of a file of postings (one task puts them in order, in memory), bytes of a row group of postings, chunks' tokens of a file of chunks.
RANGE_CHUNKS, FILE_TOKENS, ROW_GROUP, CHUNK_TOKENS = 128, 2_000_000, 4 << 20, 4_000_000
#: Ranges of ids with the highest bounds that set the score to be beaten; ranges up to which survivors are literals of the scan.
SEEDS, LITERAL_RANGES = 24, 2000
POSTINGS = "term string, range long, n long, max_tf long, min_dl int, ids array<long>, tfs array<long>, dls array<int>"
TERMS, DEAD, FILES = "term string, df long", "id long, dl int", "path string, mtime double, size long, deleted boolean"
#: Seconds for which a search may go on reading what it was planned on, though it is superseded.
LEASE = 600.0


@dataclass
class Skipped:
    """What a bounded search did: ranges with a term of a query, those it read, and those that no bound let in."""

    ranges: int = 0
    read: int = 0
    skipped: int = 0
    literal: bool = field(default=False)


def _together(spark: SparkSession, *calls: Callable[[], Any]) -> list[Any]:
    """The results of calls whose jobs don't need each other, run side by side."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


class SegmentIndex:
    """Segments under `path`; `columns` is the schema of chunks (id, path and dl among them), `body` the text that is indexed."""

    def __init__(self, spark: SparkSession, path: str, columns: str, body: Column, lease: float = LEASE):
        self.spark, self.path, self.columns, self.body, self.lease = spark, path, columns, body, lease
        self.schemas = {"chunks": columns, "postings": POSTINGS, "terms": TERMS, "dead": DEAD, "files": FILES}

    # -- state ---------------------------------------------------------------------------

    def state(self) -> dict:
        return json.loads(store.read_text(self.spark, f"{self.path}/state.json") or "{}")

    def commit(self, state: dict) -> None:
        store.write_text(self.spark, f"{self.path}/state.json", json.dumps(state, indent=2) + "\n")

    def read(self, table: str, segments: Iterable[dict]) -> DataFrame:
        """Rows of a table in these segments, as one scan; `seg` is a row's segment."""
        numbers = [s["seg"] for s in segments if table != "dead" or s["dead"]]
        base = f"{self.path}/{table}"
        if not numbers:
            return self.spark.createDataFrame([], self.schemas[table] + ", seg long")
        return self.spark.read.schema(self.schemas[table] + ", seg long").option("basePath", base).parquet(*[f"{base}/seg={n}" for n in numbers])

    def _write(self, table: str, number: int, rows: DataFrame) -> None:
        """Rows as they are dealt out, to where they will be read; a folder of this number may be left of an update that stopped."""
        names = [c.split()[0] for c in self.schemas[table].split(", ")]
        rows.select(*names).write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(f"{self.path}/{table}/seg={number}")

    # -- updates -------------------------------------------------------------------------

    def update(self, files: DataFrame, chunks: DataFrame, state: dict | None = None, **about) -> dict:
        """Replace all that the touched files (path, mtime, size, deleted) hold by these chunks, as one commit; returns the new state.

        Chunks are computed once: they are written first, and the rest is made of what lies there.
        `about` goes into the state.
        """
        state = self.state() if state is None else state
        number, before = state.get("next", 1), Snapshot(self, state)
        own = {"seg": number, "dead": 0}
        _together(self.spark, lambda: self._write("files", number, files.repartition("path").sortWithinPartitions("path")), lambda: self._write("chunks", number, chunks.repartition("path").sortWithinPartitions("path")))

        def postings() -> tuple[int, int]:
            new = self.read("chunks", [own])
            n, tokens = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            tf = lexical.postings_of(new.select("id", self.body.alias("_body")), "id", "_body").withColumnRenamed("chunk_id", "id")
            self._blocks(number, tf, n, tokens)
            return n, tokens

        def taken() -> tuple[DataFrame, int, int]:
            dead = before.chunks_of(self.read("files", [own]).select("path"))
            if self.segments_of(state):
                self._write("dead", number, dead.select("id", "dl"))
                return dead, *self.read("dead", [own | {"dead": 1}]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            return dead, 0, 0

        (n, tokens), (dead, n_dead, dead_tokens) = _together(self.spark, postings, taken)
        df = self.read("postings", [own]).groupBy("term").agg(F.sum("n").alias("df"))
        if n_dead:
            df = df.unionByName(dead.select(F.explode(F.array_distinct(index_tokens(self.body))).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
        self._terms(number, df)
        made = {"seg": number, "n": n, "tokens": tokens, "dead": n_dead}
        state = {
            **state, **about, "next": number + 1, "segments": [*self.segments_of(state), made],
            "chunks": state.get("chunks", 0) + n - n_dead, "tokens": state.get("tokens", 0) + tokens - dead_tokens,
        }
        self.commit(state)
        while (start := self._merge_from(state)) is not None:
            state = self._merge(state, start)
        self.vacuum(state)
        return state

    @staticmethod
    def segments_of(state: dict) -> list[dict]:
        return state.get("segments", [])

    def _blocks(self, number: int, postings: DataFrame, n: int, tokens: int) -> None:
        """Write postings (term, id, tf, dl) in blocks; a range of ids holds about RANGE_CHUNKS of the n chunks, as ids are hashes or serial.

        Putting them in the order of terms samples them first; so those of several files are
        written once before, lest they be made twice.
        """
        ranges, files = max(1, -(-n // RANGE_CHUNKS)), max(1, -(-tokens // FILE_TOKENS))
        held = postings.select("term", "id", "tf", "dl")
        held = materialise(held, "counted") if files > 1 else held
        dealt = held.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges))).repartitionByRange(files, "term", "range")
        rows = F.sort_array(F.collect_list(F.struct("id", "tf", "dl")))
        blocks = dealt.groupBy("term", "range").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), rows.alias("rows"))
        parts = blocks.withColumns({"ids": F.col("rows.id"), "tfs": F.col("rows.tf"), "dls": F.col("rows.dl")})
        self._write("postings", number, parts.sortWithinPartitions("term", "range"))
        if files > 1:
            release(held)

    def _terms(self, number: int, rows: DataFrame) -> None:
        whole = rows.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        self._write("terms", number, whole.sortWithinPartitions("term"))

    def _merge_from(self, state: dict) -> int | None:
        """The place of the oldest segment to merge with all younger ones, if it is time.

        Time is when there are more than MOST_SEGMENTS, or dead rows are as many as live
        ones.  A segment takes part if those younger have a FANOUT-th of its size together,
        so the large old ones are rewritten seldom.
        """
        segments = self.segments_of(state)
        if len(segments) > 1 and sum(s["dead"] for s in segments) > state["chunks"]:
            return 0
        if len(segments) <= MOST_SEGMENTS:
            return None
        younger, start = 0, len(segments) - 2
        for i in range(len(segments) - 1, -1, -1):
            size = segments[i]["n"] + segments[i]["dead"] + 1
            if younger and size <= FANOUT * younger:
                start = min(start, i)
            younger += size
        return start

    def _merge(self, state: dict, start: int) -> dict:
        number, segments = state["next"], state["segments"]
        merged = segments[start:]
        live = lambda rows: live_rows(rows, self.read("dead", merged), sum(s["dead"] for s in merged))
        own = {"seg": number, "dead": 1}

        def files() -> None:
            rows = self.read("files", merged).withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seg"))))
            self._write("files", number, rows.filter("_n = 1").sortWithinPartitions("path"))

        def rest() -> tuple[int, int]:
            self._write("chunks", number, live(self.read("chunks", merged)).repartition("path").sortWithinPartitions("path"))
            n, tokens = self.read("chunks", [own]).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            self._blocks(number, live(postings_in(self.read("postings", merged))), n, tokens)
            return n, tokens

        def dead() -> int:
            if not start:  # what is merged with the oldest segment has nothing left to be taken from
                return 0
            self._write("dead", number, self.read("dead", merged).groupBy("id").agg(F.max("dl").alias("dl")))
            return self.read("dead", [own]).count()

        (n, tokens), n_dead, *_ = _together(self.spark, rest, dead, files, lambda: self._terms(number, self.read("terms", merged)))
        state = {**state, "next": number + 1, "segments": [*segments[:start], {"seg": number, "n": n, "tokens": tokens, "dead": n_dead}]}
        self.commit(state)
        return state

    # -- readers -------------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        """The index as it is now, kept readable until it is closed; also a context manager."""
        while True:
            state = self.state()
            pin = f"{self.path}/pins/{uuid.uuid4().hex}.json"
            store.write_text(self.spark, pin, json.dumps({"segments": [s["seg"] for s in state.get("segments", [])], "until": None}))
            if self.state().get("next") == state.get("next"):  # no vacuum can have passed between the state and the pin
                return Snapshot(self, state, pin)
            delete(self.spark, pin)

    def leased(self) -> Snapshot:
        """The index as it is now, kept readable for LEASE seconds; searches of one state share a lease."""
        while True:
            state = self.state()
            pin = f"{self.path}/pins/lease-{state.get('next', 0)}.json"
            if self.lease > 0:
                held = json.loads(store.read_text(self.spark, pin) or "{}")
                if held.get("until", 0) < time.time() + self.lease / 2:
                    store.write_text(self.spark, pin, json.dumps({"segments": [s["seg"] for s in state.get("segments", [])], "until": time.time() + self.lease}))
                    if self.state().get("next") != state.get("next"):
                        continue
            return Snapshot(self, state)

    def vacuum(self, state: dict | None = None) -> list[int]:
        """Delete the segments that neither the state nor an open snapshot nor a running lease names; returns their numbers."""
        state = self.state() if state is None else state
        needed = {s["seg"] for s in state.get("segments", [])}
        for name in store.names(self.spark, f"{self.path}/pins"):
            pin = json.loads(store.read_text(self.spark, f"{self.path}/pins/{name}") or "{}")
            if pin and (pin["until"] is None or pin["until"] > time.time()):
                needed |= set(pin["segments"])
            elif pin:
                delete(self.spark, f"{self.path}/pins/{name}")
        gone = set()
        for table in self.schemas:
            for name in store.names(self.spark, f"{self.path}/{table}"):
                number = int(name.removeprefix("seg=")) if name.startswith("seg=") else None
                if number is not None and number not in needed and number < state.get("next", 1):
                    delete(self.spark, f"{self.path}/{table}/{name}")
                    gone.add(number)
        return sorted(gone)


def live_rows(rows: DataFrame, dead: DataFrame, n_dead: int) -> DataFrame:
    """Rows (seg, id, ...) that no younger segment names dead; n_dead bounds the rows of dead."""
    if not n_dead:
        return rows
    named = dead.groupBy(F.col("id").alias("_id")).agg(F.max("seg").alias("_seg"))
    named = F.broadcast(named) if n_dead <= MAX_ROWS else named
    return rows.join(named, (F.col("id") == F.col("_id")) & (F.col("_seg") > F.col("seg")), "left_anti")


def postings_in(blocks: DataFrame, *keep: str) -> DataFrame:
    """(seg, *keep, term, id, tf, dl) of blocks."""
    rows = blocks.select("seg", *keep, "term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("_p"))
    return rows.select("seg", *keep, "term", F.col("_p.ids").alias("id"), F.col("_p.tfs").alias("tf"), F.col("_p.dls").alias("dl"))


class Snapshot:
    """The rows of one state of an index."""

    def __init__(self, index: SegmentIndex, state: dict, pin: str | None = None):
        self.index, self.state, self.pin, self.spark = index, state, pin, index.spark
        self.segments = state.get("segments", [])
        self.skipped = Skipped()

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """What this snapshot alone needs may be deleted from now on."""
        if self.pin:
            delete(self.spark, self.pin)
            self.pin = None

    def _live(self, rows: DataFrame) -> DataFrame:
        return live_rows(rows, self.index.read("dead", self.segments), sum(s["dead"] for s in self.segments))

    def chunks(self) -> DataFrame:
        return self._live(self.index.read("chunks", self.segments)).drop("seg")

    def files(self) -> DataFrame:
        """The newest row of each path, deleted ones too."""
        rows = self.index.read("files", self.segments)
        if len(self.segments) > 1:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seg")))).filter("_n = 1").drop("_n")
        return rows.drop("seg")

    def chunks_of(self, paths: DataFrame) -> DataFrame:
        """The live chunks of some paths; few are literals of the scan."""
        rows = self.index.read("chunks", self.segments)
        few = [r.path for r in paths.select("path").distinct().limit(LITERAL_TERMS + 1).collect()]
        rows = rows.filter(F.col("path").isin(few)) if len(few) <= LITERAL_TERMS else rows.join(broadcast_if_small(paths.distinct()), "path", "left_semi")
        return self._live(rows).drop("seg")

    def totals(self) -> DataFrame:
        """(n, avgdl) of the live chunks, from the state."""
        n = self.state.get("chunks", 0)
        return self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(self.state.get("tokens", 0) / max(1, n)).alias("avgdl"))

    def _of_terms(self, rows: DataFrame, few: list[str], terms: DataFrame) -> DataFrame:
        if len(few) <= LITERAL_TERMS:
            return rows.filter(F.col("term").isin(few))
        return rows.join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")

    def lexical(self, queries: DataFrame) -> LexicalIndex:
        """The live postings of the queries' terms, with exact frequencies and totals of the whole index."""
        terms = terms_of_queries(queries)
        few = [r.term for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        postings = self._live(postings_in(self._of_terms(self.index.read("postings", self.segments), few, terms)))
        df = self._of_terms(self.index.read("terms", self.segments), few, terms).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return LexicalIndex(postings.select("term", F.col("id").alias("chunk_id"), "tf", "dl"), None, df, self.totals())

    def bm25_topk(self, queries: DataFrame, k: int = CANDIDATES, seeds: int = SEEDS) -> DataFrame:
        """(query_id, chunk_id, score, rank): what lexical.bm25_topk gives on all postings, from the ranges of ids that matter.

        A range's bound is the sum over the query's terms of what its largest tf and least dl
        would score.  The ranges of the highest bounds are scored first; the k-th score there
        is to be beaten, and ranges whose bound is below it are left unread.  `skipped` then
        tells how many.
        """
        index = self.lexical(queries)
        terms = terms_of_queries(queries)
        few = [r.term for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        weighed = terms.join(index.term_df, "term").crossJoin(F.broadcast(index.totals))  # totals is one row
        raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = weighed.select("query_id", "term", (F.col("qtf") * F.when(raw > 0, raw).otherwise(LEAST_IDF)).alias("w"), "avgdl")
        weighed = materialise(weighed, "weights")
        joined = broadcast_if_small(weighed)
        n_pairs = self.state.get("chunks", 0) * weighed.select("query_id").distinct().count()
        blocks = self._of_terms(self.index.read("postings", self.segments), few, terms)

        def part(tf: str, dl: str) -> Column:
            return F.col("w") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col("avgdl")))

        # a little above, for the rounding of sums and quotients
        bound = (part("max_tf", "min_dl") * (POINT * (1 + 1e-9)) + 2).cast("long")
        bounds = blocks.select("seg", "term", "range", "max_tf", "min_dl").join(joined, "term").groupBy("query_id", "seg", "range").agg(F.sum(bound).alias("most"))
        bounds = materialise(bounds, "bounds")

        def scores(pairs: DataFrame, among: DataFrame) -> DataFrame:
            """Exact scores of the chunks in the ranges (query_id, seg, range) of pairs.

            Blocks are brought together by range and meet the queries there, so what is
            shuffled is a block once, however many queries ask for it.
            """
            ranges = pairs.select("seg", "range").distinct()
            among = among.join(F.broadcast(ranges), ["seg", "range"], "left_semi") if is_small(ranges) else among
            asked = dealt_for(pairs.select("query_id", "seg", "range"), n_pairs, "seg", "range").groupBy("seg", "range").agg(F.collect_set("query_id").alias("asked"))
            named = dealt_for(among, n_pairs, "seg", "range").join(asked, ["seg", "range"]).join(joined, "term").filter(F.array_contains("asked", F.col("query_id")))
            rows = self._live(postings_in(named, "query_id", "range", "w", "avgdl"))
            rows = rows.groupBy("seg", "range", "query_id", F.col("id").alias("chunk_id"))
            return rows.agg((F.sum((part("tf", "dl") * POINT + 0.5).cast("long")) / F.lit(float(POINT))).alias("score")).select("query_id", "chunk_id", "score")

        order = Window.partitionBy("query_id").orderBy(F.desc("most"), "seg", "range")
        first = bounds.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= seeds)
        least = top_ranked(scores(first, blocks), k).filter(F.col("rank") == k).select("query_id", (F.col("score") * POINT).cast("long").alias("least"))
        survivors = bounds.join(broadcast_if_small(least, known_by=queries), "query_id", "left").filter("least IS NULL OR most >= least")
        survivors = materialise(survivors.select("query_id", "seg", "range"), "survivors")
        self.skipped = Skipped(ranges=bounds.count(), read=survivors.count())
        self.skipped.skipped = self.skipped.ranges - self.skipped.read
        among = blocks
        if self.skipped.read <= LITERAL_RANGES:  # the scan itself skips pages without these ranges
            named = sorted({r.range for r in survivors.select("range").distinct().collect()})
            among, self.skipped.literal = blocks.filter(F.col("range").isin(named)), True
        return top_ranked(scores(survivors, among), k)
