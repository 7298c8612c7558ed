"""Operator 13: repair of conversation structure by dynamic programming over a trie of signatures.

A conversation is reduced to its signature, one letter a turn, which says what the turn's role
begins with and what its fault allows.  Signatures are dealt out in sorted order, so those that
begin alike follow one another: they are read as the paths of a trie.  A layer of the dynamic
program, the least cost to each state after so many turns, is computed once for the prefix that
signatures share; where a signature ends, its answer is traced through the layers of its path,
and equal signatures take the answer of the first.  Edits are then applied to the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: White space; costs of edits, and of a truncated turn that stays; what each state inserts.
WHITE = " \t\n\x0b\x0c\r"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted turn, or one of a new role, leads to: roles are (s?(ua)+)?
NEXT = (USER, USER, ASSISTANT, USER)
#: The states that a turn which stays may lead from and to, by what its role begins with.
KEEPS = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),), "o": ()}
_FAR = 1 << 60
#: Conversations of a task, on average.
TASK_ROWS = 200_000


def _edges(letter: str) -> list[tuple[str, int, int, int]]:
    """(edit, state, next state, cost) of a turn, in the order of edits: x may only be deleted, capitals are truncated."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if letter != "x":
        more = TRUNCATED * letter.isupper()
        out += [("K", q, to, more) for q, to in KEEPS[letter.lower()]]
        out += [("R", q, NEXT[q], REROLE + more) for q in range(4)]
    return out


EDGES = {letter: _edges(letter) for letter in "suaoSUAOx"}


class SignatureTrie:
    """The open path of a trie of sorted signatures, with the layer of each of its prefixes."""

    def __init__(self):
        self.signature, self.answer = "", None
        self.layers = [self._closed([0, _FAR, _FAR, _FAR])]
        self.computed = 0

    @staticmethod
    def _closed(costs: list[int]) -> list[int]:
        """Costs with the turns that may be inserted here; two at most are ever worth it."""
        costs[USER] = min(costs[USER], INSERT + min(costs[START], costs[SYSTEM], costs[ASSISTANT]))
        costs[ASSISTANT] = min(costs[ASSISTANT], INSERT + costs[USER])
        return costs

    def insert(self, signature: str) -> tuple[int, str]:
        """(least cost, ASCII-least of the cheapest edits) of a signature."""
        if self.answer is not None and signature == self.signature:
            return self.answer
        at, least = 0, min(len(signature), len(self.signature))
        while at < least and signature[at] == self.signature[at]:
            at += 1
        layers = self.layers
        del layers[at + 1 :]
        for letter in signature[at:]:
            before, made = layers[-1], [_FAR] * 4
            for _, q, to, cost in EDGES[letter]:
                if before[q] + cost < made[to]:
                    made[to] = before[q] + cost
            layers.append(self._closed(made))
            self.computed += 1
        self.signature, self.answer = signature, self._trace(signature)
        return self.answer

    def _trace(self, signature: str) -> tuple[int, str]:
        layers = self.layers
        total = min(layers[-1][START], layers[-1][ASSISTANT])
        # from the end: the states on cheapest ways
        good = [q in (START, ASSISTANT) and layers[-1][q] == total for q in range(4)]
        on_way = [good]

        def before_inserts(good: list[bool], costs: list[int]) -> None:
            for q in (USER, START, SYSTEM, ASSISTANT):
                good[q] = good[q] or (good[NEXT[q]] and costs[q] + INSERT == costs[NEXT[q]])

        before_inserts(good, layers[-1])
        for at in range(len(signature) - 1, -1, -1):
            costs, after, next_good = layers[at], layers[at + 1], on_way[-1]
            good = [False] * 4
            for _, q, to, cost in EDGES[signature[at]]:
                if next_good[to] and costs[q] + cost == after[to]:
                    good[q] = True
            before_inserts(good, costs)
            on_way.append(good)
        on_way.reverse()
        # from the start: the least edit that stays on them
        out, at, q, n = [], 0, START, len(signature)
        while at < n or not (q in (START, ASSISTANT) and layers[at][q] == total):
            costs, options = layers[at], {}
            if at < n:
                for edit, q0, to, cost in EDGES[signature[at]]:
                    if q0 == q and on_way[at + 1][to] and costs[q] + cost == layers[at + 1][to]:
                        options.setdefault(edit, (at + 1, to))
            if on_way[at][NEXT[q]] and costs[q] + INSERT == costs[NEXT[q]]:
                options["I"] = (at, NEXT[q])
            edit = min(options)
            out.append(edit)
            at, q = options[edit]
        return total, "".join(out)


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, live) of turns damaged by their ids, as the query's contract says.

    A null is one blank; dropped turns come with live false, so that their conversation is
    known.  Rows without a conv_id belong to no conversation and are left out.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("how") != 0).alias("live"))


def _digest(role: Column, text: Column) -> Column:
    return F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(32))


def signatures(turns: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal) of turns (conv_id, turn, role, text, live).

    Turns go by `turn`, nulls first, equal ones by a digest of role and text.  Texts are not
    shuffled: a turn moves as its digest and what is asked of it.
    """
    ended = F.rtrim("text", F.lit(WHITE))
    facts = turns.select(
        "conv_id", "turn", "live", _digest(F.col("role"), F.col("text")).alias("d"), F.left("role", F.lit(1)).alias("i"), (ended == "").alias("no_word"), (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("open")
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "live", "d").orderBy("turn")
    facts = facts.withColumn("again", F.row_number().over(same))
    order = Window.partitionBy("conv_id", "live").orderBy("turn", "d", "again")
    fault = F.when(F.col("no_word"), "blank").when(F.col("again") > 1, "duplicate").when(F.col("open"), "truncated")
    kind = F.when(F.col("i").isin("s", "u", "a"), F.col("i")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    was, was_i = F.lag("turn").over(order), F.lag("i").over(order)
    seen = facts.withColumn("fault", fault).withColumns({
        "letter": letter,
        "illegal": was_i.isNotNull() & ~F.concat(was_i, F.col("i")).isin("su", "ua", "au"),
        "new": F.col("turn").isNotNull() & (was.isNull() | (was != F.col("turn"))),
    })
    live = lambda c: F.count_if(F.col("live") & F.coalesce(c, F.lit(False)))
    turn = F.when(F.col("live"), F.col("turn"))
    order_of = F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("turn", "d", "again", "letter"))))
    return seen.groupBy("conv_id").agg(
        order_of.alias("placed"),
        F.coalesce(F.max(turn) - F.min(turn) + 1 - live(F.col("new")), F.lit(0)).alias("gaps"),
        *[live(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        live(F.col("illegal")).alias("illegal"),
    ).select("conv_id", F.array_join(F.col("placed.letter"), "").alias("signature"), "gaps", "blank", "duplicate", "truncated", "illegal")


def cheapest_edits(signed: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows of signatures with cost and audit: the edits K(eep), R(erole), D(elete), I(nsert) of the cheapest repair.

    Rows are dealt out by ranges of (signature, conv_id), so copies of one signature may lie
    in many tasks; each computes their layers once.
    """
    spark = signed.sparkSession
    kept = common.materialise(signed, "signatures")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // task_rows))
    dealt = kept.repartitionByRange(tasks, "signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    at = dealt.columns.index("signature")

    def run(batches):
        trie = SignatureTrie()
        for batch in batches:
            found = [trie.insert(s) for s in batch.column(at).to_pylist()]
            costs, audits = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.int64()), pa.array(audits, pa.string())], [*batch.schema.names, "cost", "audit"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return common.map_arrow(dealt, run, f"{fields}, cost long, audit string")


def apply_audit(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns of one conversation's rows (role, text)."""
    state, edits = START, iter(audit)

    def made(edit: str, text: str) -> tuple[str, str, str]:
        nonlocal state
        state = NEXT[state]
        return edit, ROLES[state], text

    for role, text in rows:
        while (edit := next(edits)) == "I":
            yield made("I", "")
        if edit == "R":
            yield made("R", text)
        elif edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield "K", role, text
    for _ in edits:
        yield made("I", "")


def _conversations(batches) -> Iterator[tuple[int, str, Iterator[tuple[str, str]]]]:
    """(conv_id, audit, rows) of sorted rows (conv_id, audit, role, text), of which a conversation's first holds its audit alone."""

    def flat():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    source = flat()
    ahead = next(source, None)

    def rows(conv_id):
        nonlocal ahead
        while (ahead := next(source, None)) is not None and ahead[0] == conv_id and ahead[1] is None:
            yield ahead[2:]

    while ahead is not None:
        conv_id, audit = ahead[:2]
        held = rows(conv_id)
        yield conv_id, audit, held
        for _ in held:
            pass


def _edited(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, audit, role, text): each conversation's audit, then its live turns in order, in one task."""
    head = edits.select("conv_id", "audit", *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "d")], F.lit(None).cast("long").alias("turn"), F.lit(0).alias("row"))
    body = turns.filter("live").select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", _digest(F.col("role"), F.col("text")).alias("d"), "turn", F.lit(1).alias("row"))
    return head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "d").select("conv_id", "audit", "role", "text")


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, in their order."""

    def run(batches):
        held = []
        for conv_id, audit, rows in _conversations(batches):
            for place, made in enumerate(apply_audit(rows, audit)):
                held.append((conv_id, place, *made))
                if len(held) >= 1000:
                    yield _turns(held)
                    held = []
        if held:
            yield _turns(held)

    return common.map_arrow(_edited(turns, edits), run, "conv_id long, place long, edit string, role string, text string")


def _turns(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * 3], strict=True)], ["conv_id", "place", "edit", "role", "text"])


def repaired_digests(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired role:text, joined by line ends; hashed as a stream, however long a conversation is."""

    def run(batches):
        held = []
        for conv_id, audit, rows in _conversations(batches):
            digest, joint = hashlib.sha256(), b""
            for _, role, text in apply_audit(rows, audit):
                digest.update(joint + f"{role}:{text}".encode())
                joint = b"\n"
            held.append((conv_id, digest.hexdigest()))
            if len(held) >= 10_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held):
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string())], ["conv_id", "repaired_sha256"])

    return common.map_arrow(_edited(turns, edits), run, "conv_id long, repaired_sha256 string")


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_conversations(turns: DataFrame) -> DataFrame:
    """COLUMNS, one row a conversation of turns (conv_id, turn, role, text, live).

    A conversation without live turns has zeros, an empty audit and the hash of nothing.
    Other columns are not read; an empty table gives an empty result; repeated rows are
    duplicates but for the first.
    """
    edits = common.materialise(cheapest_edits(signatures(turns)), "edits")
    return edits.join(repaired_digests(turns, edits), "conv_id").select(*COLUMNS)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged_turns(common.table(spark, sf_dir, "conversations")))


def _step(state: str, edit: str, cost: str, line: str | None, when: str = "true") -> str:
    lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
    return f"CASE WHEN {state}.c IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {lines}}} END"


def _sql() -> str:
    least = lambda *options: "list_min([" + ", ".join(options) + "])"
    as_is, user, assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    stays = "fault NOT IN ('blank', 'duplicate')"
    raw = {
        "r0": least(_step("q0", "D", "4", None)),
        "r1": least(_step("q1", "D", "4", None), _step("q0", "K", "tr", as_is, f"i = 's' AND {stays}")),
        "r2": least(_step("q2", "D", "4", None), *[_step(q, "K", "tr", as_is, f"i = 'u' AND {stays}") for q in ("q0", "q1", "q3")], *[_step(q, "R", "3 + tr", user, stays) for q in ("q0", "q1", "q3")]),
        "r3": least(_step("q3", "D", "4", None), _step("q2", "K", "tr", as_is, f"i = 'a' AND {stays}"), _step("q2", "R", "3 + tr", assistant, stays)),
    }
    to_user = least("r2", *[_step(q, "I", "3", "'user:'") for q in ("r0", "r1", "r3")])
    to_assistant = least("r3", _step("u", "I", "3", "'assistant:'"))
    closed = lambda source: f"SELECT conv_id, pos, r0 AS q0, r1 AS q1, u AS q2, {to_assistant} AS q3 FROM (SELECT *, {to_user} AS u FROM ({source}))"
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"
    begin = f"SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 't': []}}::{kind} AS r0, NULL::{kind} AS r1, NULL::{kind} AS r2, NULL::{kind} AS r3 FROM base"
    onward = "SELECT faulted.conv_id, faulted.pos, " + ", ".join(f"{v} AS {k}" for k, v in raw.items()) + " FROM layers JOIN faulted ON faulted.conv_id = layers.conv_id AND faulted.pos = layers.pos + 1"
    key = "conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' ')"
    digest = "sha256(length(role) || ':' || role || text)[:32]"
    return rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {common.CRC32_SQL.format(key)} % 20 AS how FROM conversations WHERE conv_id IS NOT NULL
), dam AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k
  FROM base
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {digest}, k) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS again, role[:1] AS i
  FROM dam
), faulted AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS tr, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS was FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault FROM placed)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faulted GROUP BY conv_id
), layers AS (
  {closed(begin)}
  UNION ALL
  {closed(onward)}
), ends AS (
  SELECT conv_id, pos, list_min([q0, q3]) AS best FROM layers
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counts USING (conv_id) WHERE e.pos = coalesce(n, 0)
"""


ORACLE = _sql()
