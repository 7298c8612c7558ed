"""Exact nearest neighbours by inner product of unit vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwood.functions.text import dot

from .lexical import CANDIDATES, top_ranked
from .workers import map_arrow, ship_package

#: Bytes of query vectors that are broadcast, or meet a block of vectors in one task, and the bytes of such a block.
QUERY_BYTES, VECTOR_BYTES = 16 << 20, 64 << 20
_FOUND = "query_id long, chunk_id long, score double"


def nearest_to(vectors: DataFrame, query: Column, k: int = CANDIDATES, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """The k nearest to one literal vector: a projection and a bounded top-k, all in the JVM.

    A vector without a finite score takes no part: one that is null or holds a null, NaN or infinity.
    """
    scored = vectors.select(F.col(id_col).alias("chunk_id"), dot(F.col(vec_col), query).alias("score"))
    scored = scored.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is whole."""
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return df.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest vectors of each query (query_id, vec).

    Vectors are read once.  Query vectors of QUERY_BYTES at most are broadcast, and every task
    answers with its k best per query, so the shuffle carries k rows a query and task.  More
    queries meet the vectors in blocks of both, dealt by hash and brought together by a
    shuffle; nothing passes through the driver.  Ids are unique.  A vector that is null, empty
    or holds a null, NaN or infinity takes no part, nor do a vector and a query of different
    lengths meet.
    """
    spark = vectors.sparkSession
    v, q = _usable(vectors, id_col, vec_col), _usable(queries, "query_id", "vec")
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], _FOUND + ", rank int")
    if n * width * 8 <= QUERY_BYTES:
        asked = spark.sparkContext.broadcast(_by_width([(r.id, r.v) for r in q.orderBy("id").collect()]))
        return top_ranked(map_arrow(v, lambda batches: _search(batches, asked.value, k), _FOUND), k)
    total, widest = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    q_blocks, v_blocks = -(-n * width * 8 // QUERY_BYTES), max(1, -(-total * (widest or 1) * 8 // VECTOR_BYTES))
    place = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = q.select("id", "v", place(q_blocks).alias("qi"), every(v_blocks).alias("vi"))
    right = v.select("id", "v", place(v_blocks).alias("vi"), every(q_blocks).alias("qi"))

    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        found = _search(block.select(["id", "v"]).to_batches(), _by_width(list(zip(asked["id"].to_pylist(), asked["v"].to_pylist(), strict=True))), k)
        schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(found, schema)

    ship_package(spark)
    found = left.groupBy("qi", "vi").cogroup(right.groupBy("qi", "vi")).applyInArrow(meet, _FOUND)
    return top_ranked(found, k)


def _by_width(rows: list[tuple[int, list[float]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    out = {}
    for width in sorted({len(v) for _, v in rows}):
        own = [(i, v) for i, v in rows if len(v) == width]
        out[width] = (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64))
    return out


def _ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in the order of the components."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _search(batches, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The k best of all batches (id, v) for each query, as record batches; ties to the smaller id."""
    best = {w: [(np.empty(0), np.empty(0, np.int64))] * len(ids) for w, (ids, _) in asked.items()}
    for batch in batches:
        names, column = batch.column(0).to_numpy(), batch.column(1)
        widths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy().astype(np.float64)
        starts = np.r_[0, np.cumsum(widths)[:-1]] if len(widths) else widths
        for width in set(widths.tolist()) & set(asked):
            rows = np.flatnonzero(widths == width)
            own, v, q = names[rows], flat[starts[rows][:, None] + np.arange(width)], asked[width][1]
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ v.T
                n = min(k, len(v))
                kth = np.partition(rough, -n, axis=1)[:, -n]
                for i in range(len(rough)):
                    near = np.flatnonzero(rough[i] >= kth[i] - 1e-9)
                    score = np.concatenate([best[width][at + i][0], _ordered_dot(np.broadcast_to(q[at + i], (len(near), width)), v[near])])
                    name = np.concatenate([best[width][at + i][1], own[near]])
                    order = np.lexsort((name, -score))[:k]
                    best[width][at + i] = (score[order], name[order])
    for width, (ids, _) in asked.items():
        sizes = [len(s) for s, _ in best[width]]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([n for _, n in best[width]])), pa.array(np.concatenate([s for s, _ in best[width]]))], ["query_id", "chunk_id", "score"])
