"""Exact nearest neighbours in two phases: codes of a byte a component, then the vectors that the codes cannot exclude.

A code is a vector divided by its own scale and rounded, with the length of what rounding left
out.  A query's inner product with the vector differs from that with the code by the query's
length times that remainder at most, so every score lies in a known interval.  Phase one reads
codes alone: the k-th largest lower end is a score that k vectors reach, and only those whose
upper end comes up to it can be among the k best.  Phase two reads these few whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.functions.text import dot

from .lexical import CANDIDATES, top_ranked
from .scratch import materialise
from .sizing import broadcast_if_small
from .vector import QUERY_BYTES, _by_width, _usable, nearest_batch
from .workers import map_arrow

#: What rounding in double precision may add to an interval; ids up to which candidates are literals of the scan; bytes of a row group of vectors.
SLACK, LITERAL_IDS, ROW_GROUP = 1e-9, 5000, 1 << 20
CODES = "id long, code binary, scale double, rest double"
#: Queries and codes that meet at a time in a worker: a table of 4 MB.
TILE_QUERIES, TILE_CODES = 256, 2048


@dataclass
class Read:
    """Vectors of an index, and those that a search read whole."""

    vectors: int = 0
    whole: int = 0


def encode(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """CODES of the vectors that can take part; see vector.nearest_batch."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            widths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            starts = np.r_[0, np.cumsum(widths)[:-1]] if len(widths) else widths
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                v = flat[starts[rows][:, None] + np.arange(width)]
                scale = np.maximum(np.abs(v).max(1) / 127, np.finfo(np.float64).tiny)
                code = np.rint(v / scale[:, None]).astype(np.int8)
                rest = np.sqrt(((v - code * scale[:, None]) ** 2).sum(1))
                raw = code.tobytes()
                packed = pa.array([raw[i * width : (i + 1) * width] for i in range(len(rows))], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), packed, pa.array(scale), pa.array(rest)], ["id", "code", "scale", "rest"])

    return map_arrow(_usable(vectors, id_col, vec_col), run, CODES)


def write_codes(vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "vec") -> None:
    """Store codes and, in the order of their ids and in small row groups, the vectors."""
    encode(vectors, id_col, vec_col).write.parquet(f"{path}/codes")
    whole = _usable(vectors, id_col, vec_col)
    whole.repartitionByRange("id").sortWithinPartitions("id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/vectors")


def _intervals(batch: pa.RecordBatch, asked: dict[int, tuple[np.ndarray, np.ndarray]]):
    """(width, first query, ids, lower ends, upper ends) of a batch of codes for the queries of each width, a row a query, in tiles of both."""
    for start in range(0, batch.num_rows, TILE_CODES):
        tile = batch.slice(start, TILE_CODES)
        names, held = tile.column(0).to_numpy(), tile.column(1).to_pylist()
        widths = np.fromiter(map(len, held), np.int64, len(held))
        scale, rest = tile.column(2).to_numpy(), tile.column(3).to_numpy()
        for width in set(widths.tolist()) & set(asked):
            rows = np.flatnonzero(widths == width)
            code = np.frombuffer(b"".join([held[i] for i in rows.tolist()]), np.int8).reshape(len(rows), width).astype(np.float64)
            for at in range(0, len(asked[width][1]), TILE_QUERIES):
                q = asked[width][1][at : at + TILE_QUERIES]
                about = (q @ code.T) * scale[rows]
                far = np.linalg.norm(q, axis=1)[:, None] * rest[rows] + SLACK * (1 + np.abs(about))
                yield width, at, names[rows], about - far, about + far


def nearest_in_two_phases(spark: SparkSession, path: str, queries: DataFrame, k: int = CANDIDATES, read: Read | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): what vector.nearest_batch gives, from a stored index of codes.

    Query vectors of QUERY_BYTES are broadcast; for more, vectors are compared whole.  Every
    task gives its k largest lower ends a query, so k rows a query and task are shuffled; it
    holds these and one tile of queries and codes, however many there are of both.
    `read` then tells how many vectors were read whole.
    """
    codes, vectors = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors")
    q = _usable(queries, "query_id", "vec")
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or n * width * 8 > QUERY_BYTES:
        return nearest_batch(vectors, queries, k, vec_col="v")
    asked = spark.sparkContext.broadcast(_by_width([(r.id, r.v) for r in q.orderBy("id").collect()]))

    def lowest(batches):
        best: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for width, at, _, low, _ in _intervals(batch, asked.value):
                low = np.concatenate([best[width, at], low], axis=1) if (width, at) in best else low
                best[width, at] = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, :k].copy()
        for (width, at), low in best.items():
            names = np.repeat(asked.value[width][0][at : at + TILE_QUERIES], low.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.arange(len(names))), pa.array(low.ravel())], ["query_id", "chunk_id", "score"])

    # the place in a task stands for the vector: only the k-th value counts
    kth = top_ranked(map_arrow(codes.select("id", "code", "scale", "rest"), lowest, "query_id long, chunk_id long, score double"), k).filter(F.col("rank") == k)
    reached = spark.sparkContext.broadcast({r.query_id: r.score for r in kth.select("query_id", "score").collect()})  # a number a query, as the queries themselves

    def candidates(batches):
        least = {w: np.array([reached.value.get(i, -np.inf) for i in names.tolist()]) for w, (names, _) in asked.value.items()}
        for batch in batches:
            for width, at, ids, _, high in _intervals(batch, asked.value):
                which, row = np.nonzero(high >= least[width][at : at + TILE_QUERIES, None])
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(asked.value[width][0][at + which]), pa.array(ids[row])], ["query_id", "id"])

    found = materialise(map_arrow(codes.select("id", "code", "scale", "rest"), candidates, "query_id long, id long"), "candidates")
    few = [r.id for r in found.select("id").distinct().limit(LITERAL_IDS + 1).collect()]
    if read is not None:
        read.vectors, read.whole = codes.count(), found.select("id").distinct().count()
    whole = vectors.filter(F.col("id").isin(few)) if len(few) <= LITERAL_IDS else vectors
    pairs = broadcast_if_small(found).join(whole, "id").join(F.broadcast(q.select(F.col("id").alias("query_id"), F.col("v").alias("q"))), "query_id")  # QUERY_BYTES at most
    return top_ranked(pairs.select("query_id", F.col("id").alias("chunk_id"), dot(F.col("v"), F.col("q")).alias("score")), k)
