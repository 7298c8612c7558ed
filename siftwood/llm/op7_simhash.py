"""Operator 7: SimHash near-duplicates with BK-trees.

Fingerprints within `radius` bits agree on radius-many fewer blocks than there are, so each
distinct fingerprint goes to one shard per choice of agreeing blocks, and any two that link
meet in a shard.  A shard's fingerprints form a BK-tree (children keyed by the integer
Hamming distance to their parent), searched along the edges within the radius alone.  The
number of blocks follows the number of fingerprints, so that shards stay small at any size.

Trees are built where the shuffle brings their shard, not broadcast: together they hold the
fingerprints of all documents, which must neither pass through the driver nor fit every
executor.  A shard yields a star of links per connected group, never all pairs, and whole
subtrees already joined to the searching fingerprint are skipped, so a dense group of
near copies costs about a path each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.operators.sizing import broadcast_if_small

from . import common
from .components import connected_components

BITS = 64


def shingles(text: str | None, k: int) -> Iterator[bytes]:
    """k-word shingles of a text, A-Z lower-cased; fewer words: the whole sequence; none: no shingle."""
    words = (text or "").encode().lower().split()
    if len(words) <= k:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(k)), strict=False))


def hashes_in(text: str | None, k: int, count: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, `count` at a time: no more of a long text's are held as objects."""
    digest, found = xxhash.xxh64_intdigest, shingles(text, k)
    while len(part := np.array([digest(s, 42) for s in islice(found, count)], dtype="<u8")):
        yield part


def fingerprint(text: str | None, k: int = 3) -> int:
    """A bit is 1 if set in over half the shingle hashes; without words 0."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in hashes_in(text, k, 4096):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(narrow, run, f"`{id_col}` long, fp long")


class BKTree:
    """Fingerprints of one shard and their connected groups."""

    def __init__(self, radius: int):
        self.radius = radius
        self.fps: list[int] = []
        self.children: list[dict[int, int]] = []
        self.group: list[int] = []
        self.whole: list[bool] = []  # the subtree below, itself included, is one group

    def root_of(self, i: int) -> int:
        g = self.group
        while g[i] != i:
            g[i] = i = g[g[i]]
        return i

    def add(self, fp: int) -> int:
        """Insert fp, join it with all in the tree within the radius, and return its place."""
        fps, children, group, whole, radius, root_of = self.fps, self.children, self.group, self.whole, self.radius, self.root_of
        new = len(fps)
        fps.append(fp)
        children.append({})
        group.append(new)
        whole.append(True)
        if not new:
            return new
        todo = [0]
        while todo:
            i = todo.pop()
            if whole[i] and root_of(i) == root_of(new):
                continue
            d = (fps[i] ^ fp).bit_count()
            if d <= radius:
                group[root_of(new)] = root_of(i)
            near = [(abs(edge - d), c) for edge, c in children[i].items() if abs(edge - d) <= radius]
            near.sort(reverse=True)  # the closest edge is followed first
            todo += [c for _, c in near]
        i, path = 0, []
        while True:
            path.append(i)
            d = (fps[i] ^ fp).bit_count()
            if d not in children[i]:
                children[i][d] = new
                break
            i = children[i][d]
        mine = root_of(new)
        for i in path:
            whole[i] = whole[i] and root_of(i) == mine
        return new


def _blocks(count: int) -> list[tuple[int, int]]:
    """The 64 bits cut into count blocks: (shift, mask)."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def block_count(n: int, radius: int, shard: int = 64) -> int:
    """The fewest blocks whose shards hold about `shard` random fingerprints of n, or fewer."""
    blocks = radius + 1
    while blocks < 2 * radius + 6 and n >> (BITS * (blocks - radius) // blocks) > shard:
        blocks += 1
    return blocks


def fingerprint_links(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links (a, b) between nodes (node, fp) that connect all fingerprints within the radius, a > b."""
    cut = _blocks(blocks)
    u = F.col("fp")
    keys = []
    for choice in combinations(range(blocks), blocks - radius):
        parts = [F.shiftrightunsigned(u, cut[b][0]).bitwiseAND(F.lit(cut[b][1])) for b in choice]
        keys.append(F.xxhash64(F.lit(".".join(map(str, choice))), *parts))

    def run(batches):
        tree, names, key = BKTree(radius), [], None
        out: list[tuple[int, int]] = []

        def close():
            least: dict[int, int] = {}
            for i, n in enumerate(names):
                r = tree.root_of(i)
                least[r] = min(n, least.get(r, n))
            out.extend((n, least[r]) for i, n in enumerate(names) if n != least[r := tree.root_of(i)])

        for batch in batches:
            for k, n, fp in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                if k != key:
                    close()
                    tree, names, key = BKTree(radius), [], k
                tree.add(fp & (2**BITS - 1))
                names.append(n)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
                out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    sharded = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "fp")
    return common.map_arrow(sharded.repartition("key").sortWithinPartitions("key"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of texts by SimHash: (doc_id, fingerprint, component_id).

    fingerprint is 16 lower-case hex digits; component_id is the smallest doc_id reachable
    over links of at most `radius` differing bits, the document itself included.  A null,
    empty or blank text has fingerprint zero and is linked like any other.  Rows with the
    same id and text repeat the same result; rows with a null id take part in no link of
    their own and get the component of their fingerprint (null if only null ids have it).
    An empty table gives an empty result; other columns are not read.
    """
    own = common.materialise(fingerprints(docs, k, id_col, text_col).withColumnRenamed(id_col, "id"), "simhash")
    known = own.filter("id IS NOT NULL")
    nodes = common.materialise(known.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    hot = common.hot_keys(nodes.select("fp", "n"))  # that of all blank texts, for one
    # one document may stand under several ids; one id with several texts joins their groups
    twice = known.select("id", "fp").distinct().groupBy("id").count().filter("count > 1").select("id")
    same = common.join_unique(known.join(twice, "id", "left_semi"), nodes.select("fp", "node"), ["fp"], hot).filter("id <> node")
    same = same.select(F.greatest("id", "node").alias("a"), F.least("id", "node").alias("b")).distinct()
    links = fingerprint_links(nodes.select("node", "fp"), radius, block_count(nodes.count(), radius)).union(same)
    found = connected_components(links)
    label = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = common.join_unique(own, label, ["fp"], hot, "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Documents whose shingles tell which are frequent: so many at least, and a share of all, so that shards are as small at any size;
#: how many frequent ones are known at most, and how the pivots of a shard grow by round.
#: These set the cost alone: any order of the shingles finds every link.
#: Bits by which SimHashes of sets may differ to be verified first.
RADIUS = 3
SAMPLE, SHARE, FREQUENT, GROWTH = 10_000, 1 / 32, 1_000_000, 16


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes_in(text, k)]))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed 64-bit number: a bit is 1 if set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def set_digest(hashes: np.ndarray) -> int:
    """The name of a shingle set, as a signed long."""
    return int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes())[:8], "little", signed=True)


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the set's hashes, rare ones first, of which sets of that similarity share one at least.

    Similar sets share `similarity` of the larger one's elements, so the first element they
    share, in an order common to all sets, has only so many before it in either.
    """
    n = len(hashes)
    if not n:
        return hashes
    weight = np.zeros(n, np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        weight = np.where(frequent[at] == hashes, counts[at], 0).astype(np.uint64)
    order = np.lexsort((hashes, weight))
    return hashes[order[: n - ceil(similarity * n - 1e-9) + 1]]


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap of a set: each hash flips the bit its low end names; as many bits as hashes, rounded up to a power of two, 64 at least.

    Bitmaps of two sets differ in no more bits than the sets differ in elements, so too many
    differing bits prove that the sets are not similar; nothing similar is passed over.
    """
    bits = 1 << max(6, int(max(len(hashes), 1) - 1).bit_length())
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the bitmaps of each pair differ, the longer one folded to the size of the other."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for m, n in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        x, y = (np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1) for side in (a, b))
        while x.shape[1] != y.shape[1]:
            half = max(x.shape[1], y.shape[1]) // 2
            x, y = (z[:, :half] ^ z[:, half:] if z.shape[1] > half else z for z in (x, y))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def pivot_pairs(batches, pivots: int, possible, schema):
    """Rows (key, node, size, at), sorted by key: each with those of the first `pivots` rows of its key that stand before it.

    Yields what `possible` leaves of (row columns, pivot columns, place of the row in its key).
    Only the pivots of the last key are held from one batch to the next.
    """
    held, place = None, 0
    for batch in batches:
        cols = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(batch.num_columns)]
        if not len(cols[0]):
            continue
        old = offset = 0
        if held is not None and held[0][0] == cols[0][0]:
            old, offset = len(held[0]), place
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        key = cols[0]
        first = np.r_[True, key[1:] != key[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        within = np.arange(len(key)) - start
        real = within + np.where(start == 0, offset - old, 0) if old else within  # the place in the key: rows between pivots and batch were let go
        rows = np.arange(old, len(key))
        for s in range(pivots):
            rows = rows[within[rows] > s]
            if not len(rows):
                break
            got = possible([c[rows] for c in cols], [c[start[rows] + s] for c in cols], real[rows])
            if got is not None and len(got[0]):
                yield pa.RecordBatch.from_arrays([g if isinstance(g, pa.Array) else pa.array(g) for g in got], schema)
        last = start[-1]
        held = [c[last : last + pivots] for c in cols]
        place = int(real[-1]) + 1


def similar_nodes(docs: DataFrame, k: int, similarity: float, id_col: str, text_col: str, join_ids: bool) -> tuple[DataFrame, DataFrame]:
    """Similar texts as (id, node) of every row and (node, id, n, group) of every node that has an id.

    A node is a set of shingles, its id the smallest that has it, n the rows that have it, its group the least node
    that can be reached; with join_ids also from one text of an id to its others.  See
    similar_groups for how.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def hashes_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingle_set(t, k).view(np.int64) for t in batch.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["hash"])

    rows = texts.filter("id IS NOT NULL")
    share = max(SHARE, SAMPLE / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("similar sample")), F.lit(1 << 30)) < share * (1 << 30))
    seen = common.map_arrow(drawn, hashes_of, "hash long").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    seen = seen.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    names, counts = seen["hash"].to_numpy().view(np.uint64), seen["n"].to_numpy()
    order = np.argsort(names)
    frequent = spark.sparkContext.broadcast((names[order], counts[order]))

    def sketch(batches):
        for batch in batches:
            nodes, sizes, bitmaps, fps, keys = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingle_set(t, k)
                nodes.append(set_digest(h))
                sizes.append(len(h))
                bitmaps.append(parity(h))
                fps.append(set_fingerprint(h))
                keys.append(prefix(h, similarity, *frequent.value).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bitmaps, pa.binary()), pa.array(fps, pa.int64()), keys], ["id", "node", "size", "bits", "fp", "keys"])

    def enough(x, y):
        """Whether sets of these sizes can be similar if this shingle, at these places, is the first they share; columns key, node, size, at.

        It need not be: then they meet in the shard of the one that is, and are judged there.
        """
        nx, ny, i, j = (c.astype(np.int64) for c in (x[2], y[2], x[3], y[3]))
        most = np.minimum(nx - i, ny - j)
        return most >= similarity * (nx + ny - most) - 1e-9

    def first_round(batches):
        """All rows but the first of each key, with that one's node, or null if they can't be similar."""

        def possible(x, y, place):
            return [*x[:4], place, pa.array(y[1], mask=~enough(x, y))]

        yield from pivot_pairs(batches, 1, possible, ["key", "node", "size", "at", "place", "pivot"])

    most = (1 - similarity) / (1 + similarity)

    def close(m, x, n, y):
        """Whether bitmaps differ by no more than similar sets of these sizes may."""
        return differing(x, y) <= (np.array(m, np.int64) + np.array(n, np.int64)) * most + 1e-9

    def further_round(pivots):
        """Pairs of rows with columns key, node, size, at, group, bits."""

        def possible(x, y, place):
            keep = np.flatnonzero(enough(x, y) & (x[4] != y[4]))
            keep = keep[close(*(c[keep].tolist() for c in (x[2], x[5], y[2], y[5])))]
            return [np.maximum(x[1], y[1])[keep], np.minimum(x[1], y[1])[keep]]

        return lambda batches: pivot_pairs(batches, pivots, possible, ["a", "b"])

    def not_ruled_out(batches):
        """Pairs (a, b, size, bits, size, bits) whose bitmaps are close."""
        for batch in batches:
            keep = pa.array(close(*(batch.column(j).to_pylist() for j in range(2, 6))))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(f) for f in found], pa.int64()), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["node", "hashes"])

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sketched = common.materialise(common.map_arrow(texts, sketch, "id long, node long, size int, bits binary, fp long, keys array<long>"), "similar")
    own = common.materialise(sketched.select("id", "node"), "similar-own")
    known = own.filter("id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("size", "bits", "fp", "keys")]  # the same for equal sets
    nodes = common.materialise(sketched.filter("id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), *firsts), "similar-nodes")
    common.release(sketched)
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    if join_ids:
        several = known.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last").select("id", "b")
        links = common.materialise(known.join(several, "id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "similar-links")

    def verified(pairs, judged):
        """The similar ones of pairs (a, b); judged: their bitmaps are close."""
        side = lambda n: nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("bits").alias(f"bits_{n}"))
        pairs = pairs.distinct()
        if not judged:
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "bits_a", "size_b", "bits_b")
            pairs = common.map_arrow(pairs, not_ruled_out, "a long, b long")
        near = common.materialise(pairs, "similar-pairs")
        wanted = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "id"), "node").select("id").distinct()
        wide = common.map_arrow(texts.join(broadcast_if_small(wanted), "id", "left_semi").select("id", "text"), sets, "node long, hashes array<long>")
        wide = common.materialise(wide.dropDuplicates(["node"]), "similar-sets")
        sides = near.join(wide.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(wide.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        found = common.materialise(common.map_arrow(sides.select("a", "b", "x", "y"), verify, "a long, b long"), "similar-links")
        common.release(near, wide)
        return found

    # by the operator's method first: SimHashes within RADIUS by BK-trees of shards, verified; the shards of shingles then find what so few bits miss
    by_fp = common.materialise(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "similar-fps")
    same = common.join_unique(nodes.select("node", "fp"), by_fp.select("fp", "least"), ["fp"], common.hot_keys(by_fp.select("fp", "n"))).filter("node <> least")
    near = fingerprint_links(by_fp.select(F.col("least").alias("node"), "fp"), RADIUS, block_count(by_fp.count(), RADIUS)).union(same.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = links.union(verified(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
    common.release(by_fp)

    shards = nodes.select("node", "size", F.posexplode("keys").alias("at", "key")).select("key", "node", "size", "at")
    shards = shards.repartition("key").sortWithinPartitions("key", "node")
    rest = common.materialise(common.map_arrow(shards, first_round, "key long, node long, size int, at int, place long, pivot long"), "similar-shards")
    links = links.union(verified(rest.filter("pivot IS NOT NULL").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")), False))
    done, pivots = 1, GROWTH
    while True:
        found = connected_components(links)
        live = rest.filter(F.col("place") >= done).join(found, "node", "left").select("key", "node", "size", "at", F.coalesce("component", "node").alias("group"), "place")
        open_keys = live.groupBy("key").agg(F.min("group").alias("g"), F.max("group").alias("h")).filter("g <> h").select("key")
        live = common.materialise(live.join(open_keys, "key", "left_semi"), "similar-open")
        if not live.limit(1).count():
            break
        common.release(found)
        near = live.join(nodes.select("node", "bits"), "node").repartition("key").sortWithinPartitions("key", "place").select("key", "node", "size", "at", "group", "bits")
        links = links.union(verified(common.map_arrow(near, further_round(pivots), "a long, b long"), True))
        common.release(rest)
        rest = live.drop("group")
        rest._scratch = live._scratch
        done, pivots = done + pivots, pivots * GROWTH
    common.release(live, rest)
    return own, nodes.select("node", "id", "n").join(found, "node", "left").select("node", "id", "n", F.coalesce("component", "node").alias("group"))


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts whose sets of k-word shingles have a Jaccard similarity of `similarity` or more: (doc_id, component_id).

    Exact up to equal 64-bit hashes.  SimHashes of the sets within RADIUS bits, found by
    BK-trees as in near_duplicates, are verified on the whole sets and joined first; the rest
    is found by shingles, whatever their bits.  Sets as similar as that share a shingle in their
    prefixes (see there), so those are the shards here.  Frequent shingles, as a bounded
    sample tells them, come last in the order, so a passage that many texts share makes no
    shard unless it is nearly all of a text.  In a shard the sets are compared with its first
    one: by size and place of the shared shingle, then by their bitmaps, and what neither
    rules out on the whole sets; what that joins needs no comparing with each other.  Shards
    with several groups left are searched on from their next sets, GROWTH times as many a
    round, until every two sets of a shard are in one group, compared, or ruled out.  Equal
    sets are one node from the start.  Texts without words are equal.  One id with several
    texts joins their groups.  Nulls, repeats and empty tables as in near_duplicates.
    """
    own, label = similar_nodes(docs, k, similarity, id_col, text_col, True)
    hot = common.hot_keys(label.select("node", "n"))
    least = label.groupBy("group").agg(F.min("id").alias("component_id"))
    label = label.join(least, "group").select("node", "component_id")
    return common.join_unique(own, label, ["node"], hot, "left").select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document left of each group of similar texts (see similar_groups): that of the smallest id.

    Rows that share an id are documents of their own if their texts are not similar: none
    goes but for its text.  Of rows alike in id and shingles one stays, the same on every run.
    Rows with a null id stay as they are.  Texts without words are alike, so one of them
    stays.  Any other columns pass through, whatever their names.  Empty tables stay empty.
    """
    own, label = similar_nodes(docs, k, similarity, id_col, text_col, False)
    keep = common.materialise(label.groupBy("group").agg(F.min(F.struct("id", "node")).alias("r")).select("r.id", "r.node"), "similar-kept")
    ids = own.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    twice = common.materialise(ids.filter("n > 1").select("id"), "similar-twice")
    gone = ids.join(keep, "id", "left_anti").select("id").union(twice).distinct()
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    clear = boxed.join(broadcast_if_small(gone), "id", "left_anti").select("own.*")
    if not twice.limit(1).count():
        return clear

    def node_of(batches):
        for batch in batches:
            made = [set_digest(shingle_set(t, k)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], ["own", "id", "node"])

    shape = boxed.select("own").schema.simpleString()[len("struct<own:") : -1]
    alike = common.map_arrow(boxed.join(broadcast_if_small(twice), "id", "left_semi").select("own", "id", "text"), node_of, f"own {shape}, id long, node long")
    one = alike.groupBy("id", "node").agg(F.min_by("own", F.sha2(F.to_json("own"), 256)).alias("own")).join(keep, ["id", "node"], "left_semi")
    return clear.unionByName(one.select("own.*"))


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
