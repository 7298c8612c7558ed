"""The retrieval engine: an index of a project's files, kept up to date, and batches of queries against it.

The index is one of segments (operators/segments.py).  A build takes the changed files in
batches; each batch is one update, which is committed by replacing one small state file.  So
readers never see half a batch, a build that stops goes on from its last whole batch, and the
index may lie in any store that the executors share.  What an update supersedes is deleted once
no snapshot or search still reads it.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions.embed import EMBEDDERS, Embedder, embedding_text
from siftwood.functions.text import image_count, index_tokens
from siftwood.operators import chunk, code, lexical, manifest, rank, vector
from siftwood.operators.segments import LEASE, SegmentIndex, Snapshot
from siftwood.operators.sizing import broadcast_if_small
from siftwood.sources import corpus, pdf, store

#: Changes of the stored form or of chunking need a new number; an index of another number is built anew.
FORMAT = 3
#: Bytes of changed files per bucket, least and most buckets, and bytes of changed files per batch of a build.
BUCKET_BYTES, BUCKETS, BATCH_BYTES = 64 << 20, (16, 1 << 16), 16 << 30
#: Chunks from which a search bounds blocks of postings rather than scoring all of its terms.
BOUNDED_CHUNKS = 1_000_000
CHUNKS = "id long, path string, line_start int, line_end int, kind string, text string, images int, context string, dl int, vec array<float>"
_PIECES = ("path", "line_start", "line_end", "kind", "text", "images", "context")


def chunk_texts(texts: DataFrame) -> DataFrame:
    """Chunks of (path, text), each by the chunker of its extension; unreadable code gives none."""
    kind = chunk.dispatch(F.col("path"))
    none = F.lit("").alias("context")
    prose = chunk.line_windows(texts.filter(kind == "text")).withColumn("context", none)
    sections = chunk.markdown_sections(texts.filter(kind == "markdown")).withColumn("context", none)
    source = code.chunk_code(texts.filter(kind == "code")).filter("error IS NULL").withColumn("images", image_count(F.col("text")))
    return prose.select(*_PIECES).unionByName(sections.select(*_PIECES)).unionByName(source.select(*_PIECES))


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of files (path, content): texts decoded, PDFs by their pages."""
    is_pdf = chunk.dispatch(F.col("path")) == "pdf"
    pages = chunk.pdf_pages(pdf.pages_of(files.filter(is_pdf))).withColumn("context", F.lit(""))
    return chunk_texts(corpus.texts_of(files.filter(~is_pdf))).unionByName(pages.select(*_PIECES))


def _batches(buckets: list[tuple[int, int]]) -> list[list[int]]:
    """Buckets (number, bytes) in batches of about BATCH_BYTES."""
    out, room = [], 0
    for b, size in buckets:
        if not out or room < size:
            out.append([])
            room = BATCH_BYTES
        out[-1].append(b)
        room -= size
    return out


class Engine:
    """An index in `index` (by default inside root) of the project at root; `index` may be in any store."""

    def __init__(self, spark: SparkSession, root: str | Path | None = None, index: str | None = None, model: str | None = None, lease: float = LEASE):
        self.spark, self.root = spark, corpus.find_root(root)
        if not index and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, name an index folder that all executors share")
        self.index = str(index) if index else str(self.root / corpus.INDEX_DIR)
        self.segments = SegmentIndex(spark, self.index, CHUNKS, embedding_text(F.col("path"), F.col("context"), F.col("text")), lease)
        state = self._state()
        name = model or os.environ.get("SIFTWOOD_MODEL") or self._config().get("model") or state.get("model") or "fast"
        self.embedder: Embedder = EMBEDDERS[name]
        self.model = name
        self.throughput: dict[str, float] = {}  # of the last build: files, chunks, seconds, and both per second

    # -- state ---------------------------------------------------------------------------

    def _read(self, name: str) -> dict:
        return json.loads(store.read_text(self.spark, f"{self.index}/{name}") or "{}")

    def _write(self, name: str, values: dict) -> None:
        if not store.exists(self.spark, f"{self.index}/.gitignore"):
            store.write_text(self.spark, f"{self.index}/.gitignore", "*\n")
        store.write_text(self.spark, f"{self.index}/{name}", json.dumps(values, indent=2) + "\n")

    def _state(self) -> dict:
        return self.segments.state()

    def _config(self) -> dict:
        return self._read("config.json")

    def configure(self, **values) -> None:
        self._write("config.json", {**self._config(), **values})

    def _about(self) -> dict:
        return {"format": self._form, "model": self.model, "indexed_at": time.time()}

    @property
    def _form(self) -> str:
        return f"{FORMAT}:{self.model}"

    def _current(self, state: dict | None = None) -> dict:
        """The state, or a fresh one if the index is of another form."""
        state = self._state() if state is None else state
        return state if state.get("format", self._form) == self._form else {"next": state.get("next", 1)}

    def snapshot(self) -> Snapshot:
        """The index as it is now, readable until it is closed, whatever is built meanwhile; a context manager."""
        held = self.segments.snapshot()
        return Snapshot(self.segments, self._current(held.state), held.pin)

    def _leased(self) -> Snapshot:
        return Snapshot(self.segments, self._current(self.segments.leased().state))

    # -- build ---------------------------------------------------------------------------

    def build(self) -> dict:
        """Bring the index up to date; returns counts of changed, removed and all files.

        Changed files are taken in batches of whole buckets, of about BATCH_BYTES; the state
        is committed after each, so a build that stops goes on from there.
        """
        if not self._state() and self.root in (Path.home(), Path(self.root.anchor)):
            raise ValueError(f"no project found at {self.root}")
        began = time.perf_counter()
        current = corpus.manifest(self.spark, self.root).persist()
        state = self._current()
        held = Snapshot(self.segments, state).files().filter("NOT deleted")
        known = held.select("path", "mtime", "size")
        changed = manifest.changed(known, current).persist()
        gone = manifest.removed(known, current).persist()
        counts = {"changed": changed.count(), "removed": gone.count(), "files": current.count()}
        if counts["changed"] or counts["removed"] or "indexed_at" not in state:
            there = changed.join(current, "path").select("path", "mtime", "size", F.lit(False).alias("deleted"))
            files = there.unionByName(known.join(gone, "path", "left_semi").withColumn("deleted", F.lit(True))).persist()
            size = F.when(F.col("deleted"), 0).otherwise(F.col("size"))
            n = min(BUCKETS[1], max(BUCKETS[0], (files.agg(F.sum(size)).first()[0] or 0) // BUCKET_BYTES))
            bucket = F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")
            sizes = files.groupBy(bucket.alias("b")).agg(F.sum(size).alias("size"))
            for batch in _batches(sorted((r.b, r["size"]) for r in sizes.collect())):  # a row per bucket
                part = files.filter(bucket.isin(batch))
                state = self._store(state, part, chunk_files(corpus.read_files(self.root, part.filter("NOT deleted"))))
            files.unpersist()
            if "indexed_at" not in state:
                state = {**state, **self._about()}
                self._write("state.json", state)
            seconds, chunks = time.perf_counter() - began, self.chunks().join(changed, "path", "left_semi").count()
            self.throughput = {"files": counts["changed"], "chunks": chunks, "seconds": round(seconds, 3), "files_per_second": round(counts["changed"] / seconds, 3), "chunks_per_second": round(chunks / seconds, 3)}
        for df in (current, changed, gone):
            df.unpersist()
        return counts

    def apply(self, versions: DataFrame) -> None:
        """Apply file versions (path, mtime, size, text, deleted), at most one a path.

        A version that is not newer than what is known of its path, a deletion included, is
        passed over, so versions may come late or twice.
        """
        state = self._current()
        held = Snapshot(self.segments, state).files().select("path", F.col("mtime").alias("_known"))
        newer = versions.join(held, "path", "left").filter("_known IS NULL OR mtime > _known").drop("_known").persist()
        if newer.limit(1).count():
            self._store(state, newer.select("path", "mtime", "size", "deleted"), chunk_texts(newer.filter("NOT deleted").select("path", "text")))
        newer.unpersist()

    def _store(self, state: dict, files: DataFrame, chunks: DataFrame) -> dict:
        """Replace what the files hold by these chunks, as one update."""
        if not store.exists(self.spark, f"{self.index}/.gitignore"):
            store.write_text(self.spark, f"{self.index}/.gitignore", "*\n")
        chunks = chunks.withColumn("id", F.xxhash64("path", "line_start", "line_end", "text"))
        body = embedding_text(F.col("path"), F.col("context"), F.col("text"))
        chunks = chunks.withColumn("vec", self.embedder.documents(body)).withColumn("dl", F.size(index_tokens(body)))
        return self.segments.update(files, chunks, state, **self._about())

    # -- queries -------------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        return self._leased().chunks()

    def search(self, queries: DataFrame | str, top_k: int = 5, detail: str = "full", refresh: bool = True) -> DataFrame:
        """Results of queries (query_id, query), or of one text, against the index."""
        if detail not in ("full", "outline"):
            raise ValueError("detail must be 'full' or 'outline'")
        if isinstance(queries, str):
            if not queries.strip():
                raise ValueError("query must not be empty")
            queries = self.spark.createDataFrame([(0, queries)], "query_id long, query string")
        if refresh:
            self.build()
        now = self._leased()
        chunks = now.chunks()
        keyword = now.bm25_topk(queries) if now.state.get("chunks", 0) >= BOUNDED_CHUNKS else lexical.bm25_topk(now.lexical(queries), queries)
        asked = queries.select("query_id", self.embedder.queries(F.col("query")).alias("vec"))
        near = vector.nearest_batch(chunks, asked)
        fused = rank.fuse(near, keyword, self.embedder.weight)
        fused = broadcast_if_small(fused, known_by=queries, per_row=2 * lexical.CANDIDATES)
        rows = chunks.join(fused, F.col("id") == F.col("chunk_id")).join(broadcast_if_small(queries), "query_id")
        rows = rows.withColumn("score", rank.reweigh(F.col("score"), F.col("query"), F.col("path"), F.col("text")))
        return rank.shape(rank.best(rows, top_k), detail)

    def stats(self) -> dict:
        state = self._state()
        return {
            "root": str(self.root), "files": self._leased().files().filter("NOT deleted").count(), "chunks": self._current(state).get("chunks", 0), "index_bytes": store.size(self.spark, self.index),
            "last_indexed": state.get("indexed_at"), "model": state.get("model"), "device": self._config().get("device", "cpu"),
        }

    def warm(self) -> None:
        """Refresh and cache the chunks ahead of the first query."""
        self.build()
        self.chunks().persist().count()


def get_context(spark: SparkSession, query: str, top_k: int = 5, root: str | Path | None = None, detail: str = "full") -> list[dict]:
    """The best chunks for a query as dicts, best first; page and note only where they apply."""
    rows = Engine(spark, root).search(query, top_k, detail).orderBy("place").collect()
    return [{k: v for k, v in r.asDict().items() if k not in ("query_id", "place") and not (v is None and k in ("page", "note"))} for r in rows]
