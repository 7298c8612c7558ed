"""Operators 7, 8 and 9 and the similarity groups against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwood.llm import common, op7_simhash, op8_quality, op9_lines
from siftwood.llm.components import connected_components


def grouped(ids, linked):
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: find(i) for i in ids}


def test_simhash_groups_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: op7_simhash.fingerprint(t) for i, t in texts.items()}
    want = grouped(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = op7_simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", c) for i, c in want.items()}


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_dense_and_chained_fingerprints(spark, blocks):
    """Clusters, chains and strays, linked by brute force and by shards of any number of blocks."""
    rng = np.random.default_rng(1)
    fps = [0, 2**64 - 1]
    for _ in range(6):
        centre = int(rng.integers(0, 2**63))
        for _ in range(25):
            flips = rng.choice(64, int(rng.integers(0, 4)), replace=False)
            fps.append(centre ^ sum(1 << int(b) for b in flips))
        for n in range(12):  # a chain, three bits a step
            centre ^= 7 << (3 * n)
            fps.append(centre)
    fps = list(dict.fromkeys(fps))
    want = grouped(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    signed = lambda x: x - 2**64 if x >> 63 else x
    nodes = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "node long, fp long")
    found = {r.node: r.component for r in connected_components(op7_simhash.fingerprint_links(nodes, 3, blocks)).collect()}
    assert {i: found.get(i, i) for i in range(len(fps))} == want


def test_blocks_follow_the_number_of_fingerprints():
    assert op7_simhash.block_count(1000, 3) == 4
    assert op7_simhash.block_count(10**8, 3) > 4
    assert op7_simhash.block_count(10**11, 3) > op7_simhash.block_count(10**8, 3)


def test_fingerprint_by_definition():
    import xxhash

    text = "A b\tc  D b c É"
    words = ["a", "b", "c", "d", "b", "c", "É"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert op7_simhash.fingerprint(text) == want
    assert op7_simhash.fingerprint("one") == xxhash.xxh64_intdigest(b"one", 42)
    assert op7_simhash.fingerprint(None) == op7_simhash.fingerprint(" \n") == 0


def test_simhash_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, "a b c d"), (9, "a b c d"), (2, "A  B c D"), (None, "a b c d"), (None, "only here"), (7, "x y z w v"), (7, "")]
    got = sorted((r.doc_id or -1, r.fingerprint[:4], r.component_id) for r in op7_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    ids = [(i, c) for i, _, c in got]
    assert ids.count((9, 2)) == 2 and (2, 2) in ids and (-1, 2) in ids and (-1, None) in ids
    assert (5, 3) in ids and (3, 3) in ids and ids.count((7, 3)) == 2  # one id with two texts joins their groups
    assert op7_simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string, fp int")).count() == 0


def test_similar_groups_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra, rows = [], docs.collect()
    for r in rows[:40]:  # near copies with a word changed here and there
        words = r.text.split()
        if len(words) > 60:
            words[len(words) // 2] = "changed"
            extra.append((r.doc_id + 10_000, " ".join(words)))
    docs = docs.union(spark.createDataFrame([*extra, (-1, None), (-2, ""), (-3, "two words")], "doc_id long, text string"))
    sets = {r.doc_id: set(op7_simhash.shingles(r.text, 5)) for r in docs.collect()}
    similar = lambda a, b: (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = grouped(sorted(sets), similar)
    assert {r.doc_id: r.component_id for r in op7_simhash.similar_groups(docs).collect()} == want
    assert len(set(want.values())) < len(want) - 20


def test_similar_pair_among_many_that_share_a_passage(spark, monkeypatch):
    """Texts around one long passage are no copies of each other, and hide no copy among them, whichever shingles count as frequent."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(300)]
    rows = []
    for doc in range(200):
        own = [f"d{doc}w{i}" for i in range(40)]
        rows.append((doc, " ".join(passage + own)))
        if doc % 10 == 0:
            copy = passage + own
            for g in rng.choice(49, 7, replace=False) * 6:
                copy[g] = f"c{doc}x{g}"
            rows.append((doc + 1000, " ".join(copy)))
    sets = {i: set(op7_simhash.shingles(t, 5)) for i, t in rows}
    want = grouped(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sum(i != c for i, c in want.items()) == 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for frequent in (200_000, 0):
        monkeypatch.setattr(op7_simhash, "FREQUENT", frequent, raising=False)
        assert {r.doc_id: r.component_id for r in op7_simhash.similar_groups(docs).collect()} == want


def test_similar_sets_of_other_repeat_counts(spark):
    """Only distinct shingles count: a passage repeated in a line leaves the set as it is, but for the seams."""
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:10] * 80 + words)), (3, " ".join(words[60:70] * 200 + words)), (4, " ".join(words + ["w3", "w7"] * 300))]
    sets = {i: set(op7_simhash.shingles(t, 5)) for i, t in rows}
    want = grouped(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert set(want.values()) == {1}
    assert {r.doc_id: r.component_id for r in op7_simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_similar_groups_are_joined_by_simhash_first(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    texts = {1: base, 2: base[:-1] + ["x"], 3: [f"v{i}" for i in range(400)]}
    bits = {i: op7_simhash.set_fingerprint(op7_simhash.shingle_set(" ".join(t), 5)) % 2**64 for i, t in texts.items()}
    hashes = op7_simhash.shingle_set(" ".join(base), 5).tolist()
    assert bits[1] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert op7_simhash.set_fingerprint(op7_simhash.shingle_set("", 5)) == 0
    seen = []
    links = op7_simhash.fingerprint_links

    def spy(nodes, radius, blocks):
        seen.append({r.fp % 2**64 for r in nodes.collect()})
        return links(nodes, radius, blocks)

    monkeypatch.setattr(op7_simhash, "fingerprint_links", spy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op7_simhash.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert seen == [set(bits.values())]


def test_bitmaps_rule_out_nothing_similar():
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 1 << 62, int(n), dtype=np.uint64)) for n in rng.integers(0, 700, 40)]
    sets += [np.unique(np.r_[s[: int(len(s) * 0.9)], t[:5]]) for s, t in zip(sets, sets[1:], strict=False)]
    a, b = [s for s in sets for _ in sets], sets * len(sets)
    found = op7_simhash.differing([op7_simhash.parity(x) for x in a], [op7_simhash.parity(y) for y in b])
    apart = np.array([len(np.setxor1d(x, y)) for x, y in zip(a, b, strict=True)])
    assert (found <= apart).all() and np.median(found[apart > 200]) > 100


def test_hubs_and_hot_groups_change_nothing(spark, monkeypatch):
    """Stars, chains, blank texts and repeated ids, with every key of two rows or more taken for hot."""
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    links = [(i, 0) for i in range(1, 40)] + [(100 + i + 1, 100 + i) for i in range(30)] + [(200, 39), (200, 130), (300, 301)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in (*range(40), *range(100, 131), 200)}, 300: 300, 301: 300}
    text = "one two three four five six seven eight nine ten"
    rows = [(i, None if i % 2 else "") for i in range(20)] + [(30 + i, text) for i in range(5)] + [(30, text + " eleven"), (None, text), (None, ""), (31, ""), (50, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hot = [sorted(map(str, f(docs).collect())) for f in (op7_simhash.near_duplicates, op7_simhash.similar_groups, op7_simhash.drop_near_copies)]
    monkeypatch.undo()
    assert hot == [sorted(map(str, f(docs).collect())) for f in (op7_simhash.near_duplicates, op7_simhash.similar_groups, op7_simhash.drop_near_copies)]


def test_repeated_ids_keep_their_texts(spark):
    """Texts that share an id are documents of their own; of rows alike in id and text one stays."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(20)) for w in "abc")
    kind = "doc_id long, text string, own string, id string, node string"
    rows = [(1, a, "x", "1", "n"), (1, a, "x", "1", "n"), (1, b, "x", "2", "n"), (2, a + " more", "y", "3", "n"), (3, c, "z", None, None), (3, c + " more", "z", "5", "n"), (None, a, "w", "6", "n"), (4, None, None, None, None), (5, "  ", None, None, None)]
    got = op7_simhash.drop_near_copies(spark.createDataFrame(rows, kind))
    assert got.columns == ["doc_id", "text", "own", "id", "node"]
    left = sorted((r.doc_id or 0, r.text or "", r.own or "", r.id or "") for r in got.collect())
    one = [x for x in left if x[0] == 3]
    assert len(one) == 1 and one[0][1] in (c, c + " more")
    assert [x for x in left if x[0] != 3] == [(0, a, "w", "6"), (1, a, "x", "1"), (1, b, "x", "2"), (4, "", "", "")]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 999), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1000] == 999 and len(got) == 303
    assert connected_components(links.filter("a < 0")).count() == 0


# ---- quality -----------------------------------------------------------------------------


def brute_quality(text, least):
    w = op8_quality.WORDS(text or "")
    n = len(w)
    windows = {}
    for i in range(n - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    in3 = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    covered, longest = set(), 0
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                longest = max(longest, k)
                covered |= {*range(i, i + k), *range(j, j + k)}
    return n, len(in3), len(covered), longest


def test_repeats_match_brute_force():
    rng = np.random.default_rng(2)
    texts = [None, "", "one", "a a a a a a a a", "x y z " * 9, " ".join("abc"[int(k)] for k in rng.integers(0, 3, 60))]
    for _ in range(25):
        words = [f"w{int(k)}" for k in rng.integers(0, 30, int(rng.integers(1, 150)))]
        cut = int(rng.integers(0, len(words)))
        texts.append(" ".join(words + words[cut : cut + int(rng.integers(0, 40))]))
    for least in (3, 5, 10):
        got = op8_quality.measure(texts, least)
        for i, t in enumerate(texts):
            assert (got["n_words"][i], got["n_repeat_words"][i], got["covered_words"][i], got["longest_repeat"][i]) == brute_quality(t, least), (least, t)


def test_lines_and_symbols():
    got = op8_quality.measure(["a\nb\na\n \n \nb  \nb", "# * $ % & | < > é\xa0é", "x"])
    assert got["n_dup_lines"].tolist() == [2, 0, 0] and got["n_symbols"].tolist() == [0, 8, 0] and got["word_chars"].tolist() == [5, 11, 1]


def test_verdicts(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    chunk = " ".join(f"c{i}" for i in range(120))
    rows = [(1, clean), (2, "short"), (3, None), (4, "a b c " * 60), (5, f"{chunk} {' '.join(f'm{i}' for i in range(300))} {chunk}"), (None, clean), (1, clean)]
    got = [(r.doc_id, r.base_failed, r.kept) for r in op8_quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, False, True), (2, True, False), (3, True, False), (4, True, False), (5, False, False), (None, False, True), (1, False, True)]))
    assert op8_quality.quality_rules(spark.createDataFrame([], "doc_id long, text string, kept int")).count() == 0


# ---- lines -------------------------------------------------------------------------------


def brute_lines(rows):
    """Line dedup over all pairs of distinct lines, by edit distance."""

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    first = {}
    for doc, text in rows:
        if doc is not None:
            for i, line in enumerate((text or "").split("\n")):
                w = tuple(op9_lines.WORDS(line))
                if len(w) >= op9_lines.MIN_WORDS:
                    first[w] = min(first.get(w, (doc, i)), (doc, i))
    long = sorted((p, w) for w, p in first.items() if len(w) >= op9_lines.EDIT_WORDS)
    gone = {w for k, (_, w) in enumerate(long) if any(abs(len(w) - len(v)) <= 1 and distance(w, v) <= 1 for _, v in long[:k])}
    kept = {p for w, p in first.items() if w not in gone}
    out = []
    for doc, text in rows:
        if text is None or doc is None:
            out.append((doc, text))
            continue
        lines = text.split("\n")
        out.append((doc, "\n".join(x for i, x in enumerate(lines) if len(op9_lines.WORDS(x)) < op9_lines.MIN_WORDS or (doc, i) in kept)))
    return out


def edited_rows():
    rng = np.random.default_rng(4)
    base = [[f"v{int(k)}" for k in rng.integers(0, 50, int(rng.integers(2, 16)))] for _ in range(12)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(4):
            w = list(base[int(rng.integers(0, 12))])
            for _ in range(int(rng.integers(0, 3))):
                at, what = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                w[at : at + (what != 0)] = [] if what == 1 and len(w) > 1 else [f"n{int(rng.integers(0, 4))}"]
            lines.append((" " if doc % 2 else "  ").join(w))
        rows.append((doc, "\n".join(lines)))
    return rows


def test_line_dedup_matches_brute_force(spark):
    rows = [*edited_rows(), (100, None), (101, ""), (102, "\n\n"), (None, rows_text := edited_rows()[0][1]), (103, rows_text), (104, "a a a a a a a a a"), (105, "a a a a a a a a a a"), (106, "x " * 9 + "x\nx " * 9)]
    got = op9_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, brute_lines(rows)))


def test_repeated_rows_are_treated_alike(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, line), (1, line), (2, f"{line}\nkeep this one"), (3, "it is")]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in op9_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, line, 1, 0), (1, line, 1, 0), (2, "keep this one", 2, 1), (3, "it is", 1, 0)]
    extra = spark.createDataFrame([(1, line, 7, "k")], "doc_id long, text string, line int, kept string")
    assert op9_lines.dedup_lines(extra, keep=["line", "kept"]).first().kept == "k"
    assert op9_lines.dedup_lines(extra.filter("doc_id < 0")).count() == 0


def test_a_document_of_a_hundred_thousand_lines(spark):
    """Time in proportion to the lines: they would take minutes if each were searched for among the others."""
    rows = [(1, "\n".join(f"line {i % 60_000} of many" for i in range(100_000))), (2, "line 5 of many\nx\nline 5 of"), (2, "other\nrows\nof\nthe\nsame\nid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {(r.doc_id, r.n_lines): (r.n_removed, r.text) for r in op9_lines.dedup_lines(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[1, 100_000][0] == 40_000 and got[1, 100_000][1].split("\n") == [f"line {i} of many" for i in range(60_000)]
    assert got[2, 3] == (1, "x\nline 5 of")


def test_line_bounds_are_parameters(spark):
    docs = spark.createDataFrame([(1, "one two\na b c d e"), (2, "one two\na b x d e\na b c d e")], "doc_id long, text string")
    got = lambda **kw: [r.text for r in op9_lines.dedup_lines(docs, **kw).orderBy("doc_id").collect()]
    assert got() == ["one two\na b c d e", "one two\na b x d e"]
    assert got(min_words=2, edit_words=5) == ["one two\na b c d e", ""]


@pytest.mark.parametrize(("a", "b", "near"), [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a b", True), ("a b", "a b c", True), ("a b c", "b c a", False), ("a b c d", "a b", False), ("", "a", True)])
def test_one_edit(a, b, near):
    assert op9_lines.within_one(a.split(), b.split()) is near
