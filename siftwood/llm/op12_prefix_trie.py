"""Operator 12: the prefix trie of conversations, by an external mergesort that carries shared prefixes.

Every turn becomes a digest of its role and text, so a conversation is a short key and texts are
not moved.  Keys are dealt out by ranges of (key, conv_id); a range is as long as its share of
the conversations, whatever repeats in it, since equal keys are told apart by conv_id.  A task
sorts the batches it gets into runs that carry shared prefixes and merges them with a loser tree;
the merged stream opens and closes nodes on a stack, and a closed node is finished.

Nodes on the first and the last path of a range may go on in the next one.  They are given out
in parts that add up: what a range counts twice, since it cannot see the end of the range
before, is taken back by corrections made of the first and last keys of neighbours.  Conversation
ids that end at such a node come in blocks in the order of the ranges, and are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwood.operators.sizing import broadcast_if_small

from . import common
from .lcp_merge import WIDTH, LoserTree, shared_prefix, sorted_run

#: Fixed value: a word of a turn.
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose ids are a multiple of STEP lend their first turns to those that follow; fewer than LENT turns.
STEP, LENT = 20, 4
#: Turns and conversations of a range at most, on average; ids of a block; rows of an output batch.
RANGE_TURNS, BLOCK_IDS, OUT_ROWS = 400_000, 8192, 20_000

#: What a range gives: finished nodes, parts of nodes that other ranges may share, blocks of ids, its first and last key.
FINISHED, PART, BLOCK, EDGE = 0, 1, 2, 3
_SCHEMA = (
    "kind int, node string, parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, place long, first string, first_words array<int>, last string"
)
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def rebuilt_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words): each conversation as digests of its turns, and the number of words of each turn.

    Turns go by `turn`, nulls first, equal ones by digest; a null role or text is empty.  The
    first h turns, h = crc32(conv_id) mod 4, are replaced by those of conversation
    conv_id - conv_id % 20 (% keeps the sign of conv_id); if there is none, they are dropped.
    Rows without a conv_id take no part.  Turns are shuffled once, by the group of ids that
    share lent turns; a conversation is held together as about 40 bytes a turn.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the length of the role first, so that no two turns read alike
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(WIDTH))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("d"), F.regexp_count(text, F.lit(WORD)).alias("w")
    ).filter("conv_id is not null").withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP)
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "d", "w"))).alias("own"))
    lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, LENT - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("int")
    made = own.withColumn("h", h).withColumn("lent", F.coalesce(lent, F.array().cast(own.schema["own"].dataType)))
    seq = F.concat(F.slice("lent", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return made.select("conv_id", seq.alias("seq")).select("conv_id", F.array_join(F.col("seq.d"), "").alias("key"), F.col("seq.w").alias("words"))


def node_name(key: str, depth: int) -> str:
    return hashlib.sha256(key[: depth * WIDTH].encode()).hexdigest()[:WIDTH]


class Node:
    """A node of the open path, with what its finished subtrees add up to."""

    __slots__ = ("children", "closed", "ends", "least", "n", "n_children", "leaves", "on_first", "saved", "words")

    def __init__(self, words: int, on_first: bool):
        self.words, self.on_first = words, on_first
        self.n = self.n_children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.closed: list[tuple] = []

    def take(self, conv_id: int) -> None:
        self.n += 1
        self.least = conv_id if self.least is None else min(self.least, conv_id)
        self.ends.append(conv_id)


def ids_sha256(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def trie_rows(entries: Iterator, place: int) -> Iterator[tuple]:
    """The rows of _SCHEMA of one range, from its merged entries (key, conv_id, shared prefix, words)."""
    path: list[Node] = []
    first = last = first_words = None

    def row(kind: int, node=None, parent=None, depth=None, held: Node | None = None, digest=None) -> tuple:
        counts = (held.n, held.n_children, held.leaves, held.saved) if held else (None,) * 4
        return (kind, node, parent, held.least if held else None, depth, None, *counts, digest, None, None, None, None)

    def close(key: str, last_path: bool) -> Iterator[tuple]:
        """Close the deepest node of the path, which lies on key."""
        depth, held = len(path) - 1, path.pop()
        held.leaves += held.n_children == 0
        held.saved += (held.n - 1) * held.words
        up = path[-1] if path else None
        shared = held.on_first or last_path
        if up:
            up.n, up.n_children, up.leaves, up.saved = up.n + held.n, up.n_children + 1, up.leaves + held.leaves, up.saved + held.saved
            up.least = held.least if up.least is None else min(up.least, held.least)
        if shared:
            name = node_name(key, depth)
            yield row(PART, name, node_name(key, depth - 1) if depth else None, depth, held)
            for at in range(0, len(held.ends), BLOCK_IDS):
                block = ",".join(map(str, held.ends[at : at + BLOCK_IDS]))
                yield (BLOCK, name, None, None, None, None, None, None, None, None, block, place << 32 | at, None, None, None)
            for child in held.closed:  # their parent's smallest conv_id is not known yet
                yield (*child[:2], name, *child[3:])
        else:
            for child in held.closed:
                yield (*child[:5], held.least, *child[6:])
            up.closed.append(row(FINISHED, None, None, depth, held, ids_sha256(held.ends)))

    for key, conv_id, shared, words in entries:
        if first is None:
            first, first_words = key, words
            path.append(Node(0, True))
        while len(path) - 1 > shared:
            yield from close(last, False)
        while len(path) - 1 < len(words):
            path.append(Node(words[len(path) - 1], last is None))
        path[-1].take(conv_id)
        last = key
    if first is not None:
        while path:
            yield from close(last, True)
        yield (EDGE, None, None, None, None, None, None, None, None, None, None, place, first, first_words, last)


def _ranges(batches):
    runs = []
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        runs.append(sorted_run(rows))
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (f.split() for f in _SCHEMA.split(", "))])
    held = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for r in trie_rows(iter(LoserTree(runs)), TaskContext.get().partitionId()):
        held.append(r)
        if len(held) >= OUT_ROWS:
            yield out()
            held = []
    if held:
        yield out()


def _corrections(batches):
    """What neighbours count twice: rows (node, children, leaves, saved) to be added, from the edges of two ranges."""
    for batch in batches:
        out = []
        for first, words, before in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            both = shared_prefix(before, first)
            ended = len(before) // WIDTH == both
            saved = 0
            for depth in range(both, -1, -1):
                saved += words[depth - 1] if depth else 0
                out.append((node_name(first, depth), -int(depth < both), -int(ended), saved))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), *[pa.int64()] * 3], strict=True)], ["node", "n_children", "n_leaves", "saved_tokens"])


def _hash_blocks(batches):
    """(node, ends_sha256) of blocks of ids sorted by node and place, hashed as they come."""
    node, digest = None, None
    for batch in batches:
        out = []
        for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(block.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_nodes(sequences: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, key, words): COLUMNS, one row a node.

    A conv_id that repeats is a member once a row.  An empty table has no node; sequences
    without turns are members of the root, which is then childless.  Memory of a task is its
    range, which holds about range_turns turns; nodes that ranges share are as many as the
    ranges times the depth.
    """
    spark = sequences.sparkSession
    kept = common.materialise(sequences, "trie-keys")
    size = kept.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_turns))
    dealt = kept.repartitionByRange(ranges, "key", "conv_id").select("key", "conv_id", "words")
    found = common.materialise(common.map_arrow(dealt, _ranges, _SCHEMA), "trie-nodes")
    common.release(kept)
    edges = found.filter(F.col("kind") == EDGE).select("place", "first", "first_words", "last")
    # one row a range: as many as there are ranges
    pairs = edges.select("first", "first_words", F.lag("last").over(Window.orderBy("place")).alias("before")).filter("before is not null")
    twice = common.map_arrow(pairs, _corrections, "node string, n_children long, n_leaves long, saved_tokens long")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = found.filter(F.col("kind") == PART).select("node", "parent", "conv_id", "depth", *sums)
    empty = [F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_convs")]
    together = parts.unionByName(twice.select("node", *empty, "n_children", "n_leaves", "saved_tokens"))
    shared = together.groupBy("node").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums])
    blocks = found.filter(F.col("kind") == BLOCK).select("node", F.col("ends_sha256").alias("block"), "place")
    hashed = common.map_arrow(blocks.repartition("node").sortWithinPartitions("node", "place").select("node", "block"), _hash_blocks, "node string, ends_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    shared = common.materialise(shared.join(hashed, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))), "trie-shared")
    names = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    finished = found.filter(F.col("kind") == FINISHED)
    below = finished.filter("parent is not null").drop("parent_conv_id")
    rest = ["parent", "conv_id", "depth", *sums, "ends_sha256"]
    open_rows = below.select(*rest).unionByName(shared.select(*rest))
    hot = common.hot_keys(open_rows.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")))
    named = common.join_unique(open_rows, broadcast_if_small(names), ["parent"], hot, "left")
    return finished.filter("parent is null").select(*COLUMNS).unionByName(named.select(*COLUMNS))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(rebuilt_sequences(common.table(spark, sf_dir, "conversations")))


ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT c, {common.CRC32_SQL.format("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM own)
), seqs AS (
  SELECT c, list(struct_pack(role := role, text := text) ORDER BY pos) AS seq FROM (
    SELECT heads.c, own.pos, own.role, own.text FROM heads JOIN own ON own.c = heads.c - heads.c % 20 AND own.pos <= heads.h
    UNION ALL
    SELECT heads.c, own.pos, own.role, own.text FROM heads JOIN own ON own.c = heads.c AND own.pos > heads.h)
  GROUP BY c
), convs AS (
  SELECT heads.c, coalesce(seq, []) AS seq FROM heads LEFT JOIN seqs USING (c)
), members AS (
  SELECT c, d, seq[1:d] AS path, len(seq) = d AS ends FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM convs)
), nodes AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends)), sha256('')) AS ends_sha256,
         CASE WHEN d > 0 THEN len(regexp_extract_all(path[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS w
  FROM members GROUP BY path, d
), children AS (
  SELECT path[1:d-1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), ups AS (
  SELECT path[1:k] AS top, n, w, n_children FROM (SELECT path, n, w, n_children, unnest(range(d + 1)) AS k FROM full_nodes)
), subtrees AS (
  SELECT top AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n - 1) * w)::BIGINT AS saved_tokens FROM ups GROUP BY top
)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM full_nodes a JOIN subtrees s USING (path) LEFT JOIN full_nodes b ON a.d > 0 AND b.path = a.path[1:a.d-1]
"""
