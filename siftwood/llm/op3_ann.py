"""Operator 3: approximate nearest neighbours by balanced posting lists.

Centroids, in proportion to the vectors, are fitted on a bounded sample with a penalty that
evens out their lists; many of them in two levels, so that fitting and placing look at few.
The penalty belongs to the list: every vector is stored in the list of its nearest centroid
by penalised distance, and, near a boundary, in those of further ones (closure: within a
distance ratio, and not shadowed by a nearer chosen one).  A query walks a neighbour graph of
the centroids in memory and probes the lists within a distance ratio of its nearest.  Lists
are shuffled, not gathered; a large list is dealt in chunks of vectors against chunks of
queries, so no task holds an unbounded list, and each chunk answers with its best few.

Vectors are scaled by powers of two before anything is squared, which changes no cosine, so
components of any finite size take part.  Vectors meet those of their own length alone;
lengths that few vectors have get one list each, which all their queries probe.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors per list; of the sample that fitting reads, rows at least, rows per list and bytes at most; most centroids fitted at one level, and vectors of a length that gets centroids.
LIST_SIZE, SAMPLE, PER_LIST, SAMPLE_BYTES, ONE_LEVEL, LEAST_FITTED = 192, 20_000, 8, 64 << 20, 1024, 256
#: Replicas, closure ratio, probe ratio, least and most lists probed by the walk; what a list e times too full adds to its penalty in a round, and rounds that even out lists of two levels.
REPLICAS, CLOSURE, PROBE, LEAST_PROBES, WALK, PENALTY, ROUNDS = 4, 1.15, 1.35, 12, 64, 0.02, 6
#: Vectors and queries that meet in one chunk.
VECTOR_CHUNK, QUERY_CHUNK = 4096, 1024
ALL = -1  # the list of a length without centroids


class CentroidGraph:
    """Unit centroids and, for each, its nearest other ones; searched best first."""

    def __init__(self, centroids: np.ndarray, degree: int = 24):
        self.centroids = centroids
        n = len(centroids)
        self.links = np.empty((n, min(degree, n - 1)), np.int64)
        for at in range(0, n, 512):
            near = centroids[at : at + 512] @ centroids.T
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -9
            self.links[at : at + 512] = _nearest(near, self.links.shape[1])[0]
        self.entries = np.arange(0, n, max(1, int(n**0.5)))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Up to width centroids near the unit vector q, nearest first, and their cosines."""
        scores = self.centroids[self.entries] @ q
        seen = np.zeros(len(self.centroids), bool)
        seen[self.entries] = True
        todo = [(-s, int(i)) for s, i in zip(scores.tolist(), self.entries.tolist(), strict=True)]
        best = [(-d, i) for d, i in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= width and -d < best[0][0]:
                break
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for s, j in zip((self.centroids[new] @ q).tolist(), new.tolist(), strict=True):
                if len(best) < width or s > best[0][0]:
                    heapq.heappush(todo, (-s, j))
                    (heapq.heappush if len(best) < width else heapq.heappushpop)(best, (s, j))
        best.sort(reverse=True)
        return np.array([j for _, j in best]), np.array([s for s, _ in best])


def _nearest(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each row's `count` greatest, greatest first, ties to the first place."""
    count = min(count, scores.shape[1])
    at = np.argpartition(-scores, count - 1, axis=1)[:, :count] if count < scores.shape[1] else np.broadcast_to(np.arange(count), scores.shape).copy()
    at.sort(axis=1)
    values = np.take_along_axis(scores, at, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(values, order, axis=1)


def fit_centroids(x: np.ndarray, count: int, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Balanced spherical k-means of unit vectors: centroids and penalties; a list above its fair size is made less attractive in the next round."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), count, replace=False)].copy()
    penalty = np.zeros(count)
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 2048] @ c.T - penalty).argmax(axis=1) for at in range(0, len(x), 2048)])
        sizes = np.bincount(own, minlength=count)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = sizes == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
        penalty = np.where(empty, 0.0, penalty + PENALTY * (np.log1p(sizes) - np.log1p(len(x) / count)))
    return c, penalty


class Lists:
    """The centroids of all lists with their penalties, and, where there are many, the coarse cells they were fitted in."""

    def __init__(self, sample: np.ndarray, count: int):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        count = min(count, len(x))
        self.coarse, self.cells = None, [(0, count)]
        if count <= ONE_LEVEL:
            self.centroids, self.penalty = fit_centroids(x, count)
            return
        self.coarse, _ = fit_centroids(x, int(count**0.5))
        own = np.concatenate([(x[at : at + 2048] @ self.coarse.T).argmax(axis=1) for at in range(0, len(x), 2048)])
        fitted, self.cells, first = [], [], 0
        for cell in range(len(self.coarse)):
            inside = x[own == cell]
            n = min(len(inside), max(1, round(count * len(inside) / len(x)))) if len(inside) else 0
            if n:
                fitted.append(fit_centroids(inside, n, seed=cell))
            self.cells.append((first, first + n))
            first += n
        self.centroids = np.concatenate([c for c, _ in fitted])
        self.penalty = np.zeros(first)  # those of the cells don't compare; all lists are evened out together
        for _ in range(ROUNDS):
            sizes = np.bincount(np.concatenate([self.near(x[at : at + 2048], 1)[0][:, 0] for at in range(0, len(x), 2048)]), minlength=first)
            self.penalty += PENALTY * (np.log1p(sizes) - np.log1p(len(x) / first))

    def near(self, x: np.ndarray, width: int, cells: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Per unit vector the nearest `width` lists by penalised cosine, nearest first, and those cosines; -1 and -9 where there are fewer.

        In two levels only the lists of the nearest cells are looked at.
        """
        if self.coarse is None:
            return _nearest(x @ self.centroids.T - self.penalty, width)
        lists, scores = np.full((len(x), cells * width), -1), np.full((len(x), cells * width), -9.0)
        chosen, _ = _nearest(x @ self.coarse.T, cells)
        for cell in np.unique(chosen):
            (rows, place), (a, b) = np.nonzero(chosen == cell), self.cells[cell]
            if a < b:
                at, value = _nearest(x[rows] @ self.centroids[a:b].T - self.penalty[a:b], width)
                to = place[:, None] * width + np.arange(at.shape[1])
                lists[rows[:, None], to], scores[rows[:, None], to] = at + a, value
        at, value = _nearest(scores, width)
        return np.take_along_axis(lists, at, axis=1), value


def closure(near: np.ndarray, cosines: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which of the near lists (rows: vectors, nearest first) hold each vector, others -1; distances are on the unit sphere."""
    d = np.sqrt(np.maximum(2 - 2 * cosines, 0))
    chosen = np.zeros(near.shape, bool)
    chosen[:, 0] = True
    for j in range(1, near.shape[1]):
        ok = (near[:, j] >= 0) & (d[:, j] <= CLOSURE * d[:, 0] + 1e-12) & (chosen.sum(axis=1) < REPLICAS)
        for i in range(j):
            gap = np.sqrt(np.maximum(2 - 2 * (centroids[near[:, i]] * centroids[near[:, j]]).sum(axis=1), 0))
            ok &= ~(chosen[:, i] & (gap < 0.7 * d[:, j]))
        chosen[:, j] = ok
    return np.where(chosen, near, -1)


def exact_cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision, summed component by component, so equal vectors score equally."""
    dot, qq, vv = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for j in range(q.shape[1]):
        dot += q[:, j] * v[:, j]
        qq += q[:, j] * q[:, j]
        vv += v[:, j] * v[:, j]
    return dot / (np.sqrt(qq) * np.sqrt(vv))


def best_of(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, cosine) of each query's k best ids among v, ties to the smaller id; not the query's own id.

    Rows that repeat an id count once, with the best of their scores.
    """
    out = ([], [], [])
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    starts = np.flatnonzero(np.r_[True, v_ids[1:] != v_ids[:-1]]) if len(v_ids) else np.empty(0, np.int64)
    most = min(k, len(starts))
    qn, vn = q / np.linalg.norm(q, axis=1, keepdims=True), v / np.linalg.norm(v, axis=1, keepdims=True)
    for at in range(0, len(q), 128):
        rough = qn[at : at + 128] @ vn.T
        rough[q_ids[at : at + 128, None] == v_ids[None, :]] = -9
        by_id = rough if len(starts) == len(v) else np.maximum.reduceat(rough, starts, axis=1)
        kth = np.partition(by_id, -most, axis=1)[:, -most]
        i, j = np.nonzero((rough >= kth[:, None] - 1e-9) & (rough > -5))
        score = exact_cosines(q[at + i], v[j])
        order = np.lexsort((v_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        if len(starts) < len(v):
            _, once = np.unique(i * len(starts) + np.searchsorted(starts, j, side="right") - 1, return_index=True)
            once.sort()
            i, j, score = i[once], j[once], score[once]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        for o, x in zip(out, (q_ids[at + i[keep]], v_ids[j[keep]], score[keep]), strict=True):
            o.append(x)
    return tuple(np.concatenate(o) if o else np.empty(0) for o in out)


def _by_width(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of each length in a column, each vector scaled by a power of two to a greatest component of 1/2 to 1."""
    widths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.r_[0, np.cumsum(widths)[:-1]] if len(widths) else widths
    out = []
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        x = flat[starts[rows][:, None] + np.arange(width)]
        _, exponent = np.frexp(np.abs(x).max(axis=1))
        out.append((int(width), rows, np.ldexp(x, -exponent[:, None])))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query among vectors by cosine: (query_id, rank, vec_id, score).

    Both frames have (id, vector).  A vector that is null, zero, empty, or has a null, NaN or
    infinite component takes no part; vectors of other lengths than the query's are no
    candidates; so queries may have no rows.  Ties go to the smaller id.  Rows that repeat an
    id count as one vector with the best of their scores, and equal rows are one from the
    start.  Null ids take no part.  Few vectors: all are probed, and a query gets all
    candidates if there are fewer than k.  Other columns are not read.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).dropDuplicates(["id", "v"])

    vectors, queries = common.materialise(usable(vectors), "ann-vectors"), usable(queries)
    shapes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FITTED).collect()
    schema = "query_id long, vec_id long, score double"
    lists_of = {}
    for shape in shapes:  # lengths of many vectors: one, as a rule
        bound = min(max(SAMPLE, PER_LIST * (shape.n // LIST_SIZE)), max(1, SAMPLE_BYTES // (8 * shape.d)))
        draw = F.pmod(F.xxhash64("id", F.lit("ann sample")), F.lit(1 << 30)) / float(1 << 30)
        rows = vectors.filter((F.size("v") == shape.d) & (draw < min(1.0, bound / shape.n))).limit(2 * bound).select("id", "v").toArrow().combine_chunks()
        parts = _by_width(rows["v"].combine_chunks()) if rows.num_rows else []
        if parts:
            sample = parts[0][2][np.lexsort((*parts[0][2].T[:4], rows["id"].to_numpy()))]
            lists_of[shape.d] = Lists(sample, max(1, min(shape.n // LIST_SIZE, len(sample) // PER_LIST)))
    held = spark.sparkContext.broadcast({d: (lists, CentroidGraph(lists.centroids)) for d, lists in lists_of.items()})

    def listed(part, lists: list, rows: list) -> pa.RecordBatch:
        lists, rows = (np.concatenate([np.asarray(x, np.int64) for x in xs]) if xs else np.empty(0, np.int64) for xs in (lists, rows))
        column = part.column(1).take(pa.array(rows))
        widths = pa.array(np.diff(column.offsets.to_numpy()).astype(np.int32))
        return pa.RecordBatch.from_arrays([widths, pa.array(lists), part.column(0).take(pa.array(rows)), column], ["width", "list", "id", "v"])

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, lists, rows = batch.slice(at, 1024), [], []
                for width, own, x in _by_width(part.column(1)):
                    if width not in held.value:
                        lists.append(np.full(len(own), ALL))
                        rows.append(own)
                        continue
                    fitted = held.value[width][0]
                    chosen = closure(*fitted.near(_unit(x), 2 * REPLICAS), fitted.centroids)
                    i, j = np.nonzero(chosen >= 0)
                    lists.append(chosen[i, j])
                    rows.append(own[i])
                yield listed(part, lists, rows)

    def probe(batches):
        for batch in batches:
            lists, rows = [], []
            for width, own, x in _by_width(batch.column(1)):
                for i, q in zip(own.tolist(), _unit(x), strict=True):
                    found = np.array([ALL])
                    if width in held.value:
                        found, cosines = held.value[width][1].search(q, WALK)
                        d = np.sqrt(np.maximum(2 - 2 * cosines, 0))
                        found = found[(d <= PROBE * d[0]) | (np.arange(len(d)) < LEAST_PROBES)]
                    lists.append(found)
                    rows.append(np.full(len(found), i))
            yield listed(batch, lists, rows)

    fields, key = "width int, list long, id long, v array<double>", ["width", "list"]
    lists = common.materialise(common.map_arrow(vectors, place, fields), "ann-lists")
    probes = common.materialise(common.map_arrow(queries, probe, fields), "ann-probes")
    sizes = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("nv")).join(probes.groupBy(*key).agg(F.count(F.lit(1)).alias("nq")), key)
    chunks = sizes.select(*key, F.ceil(F.col("nv") / VECTOR_CHUNK).alias("vc"), F.ceil(F.col("nq") / QUERY_CHUNK).alias("qc"))
    chunks = F.broadcast(common.materialise(chunks, "ann-chunks"))  # a row per list, whose centroid the driver has held

    def spread(df: DataFrame, own: str, other: str, salt: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.col(own)).alias("mine")
        return df.join(chunks, key).select(*key, "id", "v", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("theirs"))

    left = spread(probes, "qc", "vc", "q").select(*key, F.col("theirs").alias("vi"), F.col("mine").alias("qi"), "id", "v")
    right = spread(lists, "vc", "qc", "v").select(*key, F.col("mine").alias("vi"), F.col("theirs").alias("qi"), "id", "v")

    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        cols = [np.empty(0)] * 3
        if q.num_rows and v.num_rows:
            q, v = q.combine_chunks(), v.combine_chunks()
            matrix = lambda t: _by_width(t["v"].combine_chunks())[0][2]  # noqa: E731  a chunk has one length
            cols = best_of(q["id"].to_numpy(), matrix(q), v["id"].to_numpy(), matrix(v), k)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = [*key, "vi", "qi"]
    common.ship_package(spark)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))
