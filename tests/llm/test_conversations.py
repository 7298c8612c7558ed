"""Operators 12 and 13 against brute force."""

import hashlib
import heapq
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwood.llm import op12_prefix_trie as op12
from siftwood.llm import op13_repair as op13
from siftwood.llm.lcp_merge import WIDTH, LoserTree, shared_prefix, sorted_run

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
digest = lambda role, text: sha(f"{len(role)}:{role}{text}")[:WIDTH]
null_first = lambda v: (v is not None, v or 0)


def key_of(turns):
    return "".join(f"{t:0{WIDTH}d}" for t in turns)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 2), max_size=5), max_size=6), max_size=6))
def test_merged_runs_are_sorted_and_carry_shared_prefixes(runs):
    rows, n = [], 0
    made = []
    for run in runs:
        own = []
        for turns in run:
            own.append((key_of(turns), n, None))
            n += 1
        rows += own
        made.append(sorted_run(own))
    out = list(LoserTree(made))
    assert [(k, i) for k, i, _, _ in out] == sorted((k, i) for k, i, _ in rows)
    before = ""
    for k, _, shared, _ in out:
        assert shared == shared_prefix(before, k) == next((d for d in range(len(k) // WIDTH + 1) if before[: (d + 1) * WIDTH] != k[: (d + 1) * WIDTH] or (d + 1) * WIDTH > len(k)), 0)
        before = k


def test_shared_turns_are_not_compared_again():
    long = list(range(500))
    runs = [sorted_run([(key_of([*long, r, j]), r * 50 + j, None) for j in range(50)]) for r in range(8)]
    tree = LoserTree(runs)
    assert len(list(tree)) == 400
    assert tree.compared < 8 * 510 + 400 * 4  # reading every pair anew would be 400 * 3 * 500


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((null_first(turn), digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie_by_force(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        saved = sum((len(nodes[p]) - 1) * len([w for w in _words(p[-1][1])]) for p in below if p)
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids(path), sum(kids(p) == 0 for p in below), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def _words(text):
    import re

    return re.findall(op12.WORD, text)


def many_conversations(n=260):
    rng = random.Random(3)
    rows = []
    for c in range(n):
        if c % 3 == 0:  # a hot conversation
            turns = [("system", "be brief"), ("user", "hello there"), ("assistant", "good day to you")]
        else:
            turns = [(rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f", ""])) for _ in range(rng.randrange(1, 6))]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rows += [(-7, 0, "user", "a b"), (-45, 1, "user", "c"), (-40, 0, "user", "lent"), (900, None, None, None), (900, 0, "x", None), (901, 3, "user", "tie"), (901, 3, "user", "tie"), (901, 3, "assistant", "tie")]
    rows += [(2000, t, "user", f"t {t % 7}") for t in range(300)] + [(2001, t, "user", f"t {t % 7}") for t in range(200)] + [(None, 0, "user", "nobody")]
    return rows


@pytest.mark.parametrize("range_turns", [40, 10**6])
def test_trie_by_force(spark, range_turns):
    """Many ranges, so that hot copies and long paths lie in several, and few."""
    rows = many_conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in op12.trie_nodes(op12.rebuilt_sequences(table), range_turns).collect()]
    assert sorted(got, key=str) == trie_by_force(rebuilt(rows))


def test_blocks_of_ids_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK_IDS", 3)
    rows = [(c * 7, 0, "user", "same") for c in range(400)]
    got = op12.trie_nodes(op12.rebuilt_sequences(spark.createDataFrame(rows, SCHEMA).repartition(4)), 20).collect()
    assert sorted((tuple(r) for r in got), key=str) == trie_by_force(rebuilt(rows))


def test_trie_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert op12.trie_nodes(op12.rebuilt_sequences(empty)).count() == 0
    # every turn is before the borrowed ones, and there is nobody to borrow from: turnless, so the root is childless
    c = next(c for c in range(1, 999) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    (root,) = op12.trie_nodes(op12.rebuilt_sequences(spark.createDataFrame([(c, 0, "user", "x")], SCHEMA))).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, sha(str(c)))
    clash = spark.createDataFrame([(0, 0, "user", "x y", "k", 1)], SCHEMA + ", key string, depth int")
    assert [(r.depth, r.n_leaves) for r in op12.trie_nodes(op12.rebuilt_sequences(clash)).collect() if r.depth] == [(1, 1)]


COSTS = {"K": 0, "R": 3, "D": 4}


def repair_by_force(signature):
    """Cheapest audit by Dijkstra's search over (place, state) with whole audits compared."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, q = heapq.heappop(heap)
        if at == len(signature) and q in ("", "a"):
            return cost, audit
        if (at, q) in seen:
            continue
        seen.add((at, q))
        new = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
        heapq.heappush(heap, (cost + 3, audit + "I", at, new))
        if at < len(signature):
            letter = signature[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, q))
            if letter != "x":
                more = 3 if letter.isupper() else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, new))
                if letter.lower() in step[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, letter.lower()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("suaoSUAOx", max_size=9), max_size=12))
def test_answers_of_the_trie(signatures):
    trie = op13.SignatureTrie()
    for s in sorted(signatures):
        assert trie.insert(s) == repair_by_force(s)


def test_layers_are_computed_once_a_prefix():
    signatures = sorted(a + b for a in ("suauaua" * 20, "uauaUaxu" * 20) for b in ("", "u", "ua", "x", "xx"))
    trie = op13.SignatureTrie()
    for s in signatures:
        trie.insert(s)
        trie.insert(s)
    prefixes = {s[:n] for s in signatures for n in range(1, len(s) + 1)}
    assert trie.computed == len(prefixes)


def damaged(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        held = out.setdefault(c, [])
        how = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else "".join(x for x in text if x not in ".!?") if how == 2 else text
        role = "user" if how == 4 else role
        held += [(null_first(turn), digest(role, text), turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return {c: [h[2:] for h in sorted(v)] for c, v in out.items()}


def repaired_by_force(rows):
    want = []
    for c, turns in damaged(rows).items():
        seen, signature = set(), ""
        n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            bare = text.strip(op13.WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = repair_by_force(signature)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        lines, at, q = [], 0, ""
        for edit in audit:
            new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[q]
            _, role, text = turns[at] if edit != "I" else (0, new, "")
            at += edit != "I"
            if edit != "D":
                role = new if edit == "R" else role
                lines.append(f"{role}:{text}")
                q = role[0]
        want.append((c, gaps, *n.values(), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(want)


def broken_conversations():
    rng = random.Random(5)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([t, t * 3, None]), rng.choice(["system", "user", "assistant", "tool", "", None, "User"]), rng.choice(["Fine.", "Open", "", None, " \n", "Really?", "Cut. off ", f"Own {t}!"])))
    rows += [(500, t, ["user", "assistant"][t % 2], f"Long {t}.") for t in range(3000)]
    gone = next(c for c in range(600, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "dropped"), (None, 0, "user", "nobody"), (-3, 2, "user", "Below zero."), (-3, 2, "user", "Below zero.")]
    return rows, gone


def test_repair_by_force(spark):
    rows, gone = broken_conversations()
    turns = op13.damaged_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = sorted(tuple(r) for r in op13.repair_conversations(turns).collect())
    assert got == repaired_by_force(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", sha("")) in got


def test_repaired_turns_are_what_is_hashed(spark):
    rows, _ = broken_conversations()
    turns = op13.damaged_turns(spark.createDataFrame([r for r in rows if r[0] != 500], SCHEMA))
    edits = op13.cheapest_edits(op13.signatures(turns))
    lines = {}
    for r in op13.repaired_turns(turns, edits).orderBy("conv_id", "place").collect():
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in op13.repair_conversations(turns).collect():
        assert r.repaired_sha256 == sha("\n".join(lines.get(r.conv_id, [])))
        assert r.cost >= sum(3 * (e in "RI") + 4 * (e == "D") for e in r.audit)


def test_repair_edges(spark):
    assert op13.repair_conversations(op13.damaged_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    clash = spark.createDataFrame([(2, 5, "user", "Whole.", 1, "x")], SCHEMA + ", cost int, signature string")
    assert [tuple(r) for r in op13.repair_conversations(op13.damaged_turns(clash)).collect()] == repaired_by_force([(2, 5, "user", "Whole.")])
