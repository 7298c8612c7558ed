"""Token counts of the columns of a frame, and what makes them quick: words cut and merged many at a time, and kept by workers."""

import random

import pytest
from pyspark.sql import functions as F

from siftwood.functions import outline, text, tokens
from siftwood.functions.tokens import PATTERN, Counter, merged_length, read_ranks
from siftwood.operators.token_counts import count_columns

ODD = ["", " ", "\n\n  x", "don't we'll 'sI'd", "naïve Ünïcode 漢字かな ٣٤ ½ 🙂🙂 a\U0001d7d8b", "\u2028a\u2029 \x85b\x1c\x1fc\u3000d", "\t\ta  b \n ", "ab" * 300, " " * 90 + "end", "é‍️-\xa0x"]


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks(vocabulary):
    with open(vocabulary, "rb") as f:
        return read_ranks(f.read())


def one_by_one(ranks):
    """Counts by the pattern and merged_length, a word at a time."""
    import regex

    return lambda t: sum(merged_length(m[0].encode(), ranks) for m in regex.finditer(PATTERN, t))


def random_texts(n):
    rng = random.Random(7)
    return ["".join(rng.choice("aeiou tnrs\n'.,é漢1🙂\t\xa0\x1c") for _ in range(rng.randrange(1, 300))) for _ in range(n)]


def test_columns_of_a_frame(spark, vocabulary, ranks):
    texts, count = ODD + random_texts(60), one_by_one(ranks)
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)] + [(-1, None, "a")], "id long, a string, b string").repartition(3)
    got = {r.id: (r.a, r.b) for r in count_columns(df, ["a", "b"], vocabulary).collect()}
    assert got.pop(-1) == (None, 1)
    assert got == {i: (count(t), count(t[::-1])) for i, t in enumerate(texts)}


def test_both_engines_cut_alike(ranks):
    counter = Counter(ranks, PATTERN)
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    for sep in ("", " ", "  "):
        joined = sep.join(every)
        assert counter.fast.findall(joined) == counter.cut.findall(joined)


def test_new_words_are_merged_together_and_by_the_fast_engine(ranks, monkeypatch):
    """a word at a time by a heap, and the slower engine for every text, took most of the time."""
    counter, texts, count = Counter(ranks, PATTERN), random_texts(200), one_by_one(ranks)
    plain = [t.replace("🙂", "x") for t in texts]
    want = [count(t) for t in plain]
    monkeypatch.setattr(counter, "cut", None)
    monkeypatch.setattr(tokens, "merged_length", None)
    assert counter.counts(plain) == want


def test_workers_keep_their_counter(spark, vocabulary):
    """each task made a counter of its own, which had to merge every word again."""
    df, own = spark.range(40).select(F.lit("some words").alias("t")), PATTERN + "|never"
    made = spark.sparkContext.accumulator(0)

    class Counted(Counter):
        def __init__(self, *args):
            made.add(1)
            super().__init__(*args)

    from siftwood.operators import token_counts

    before, token_counts.Counter = token_counts.Counter, Counted
    try:
        # the counter goes to the workers with the function, which names it as what it is here
        once = count_columns(df.repartition(24), ["t"], vocabulary, own)
        assert {r.t for r in once.collect()} == {2}
    finally:
        token_counts.Counter = before
    assert 1 <= made.value <= 4


def test_a_long_text_and_a_small_memory(ranks, monkeypatch):
    texts = random_texts(120)
    want = [one_by_one(ranks)(t) for t in texts]
    monkeypatch.setattr(tokens, "LONG_TEXT", 50)
    monkeypatch.setattr(tokens, "CUT_WORDS", 7)
    monkeypatch.setattr(tokens, "NEW_WORDS", 10)
    monkeypatch.setattr(tokens, "CACHED_CHARS", 200)
    monkeypatch.setattr(tokens, "SLAB", 3)
    counter = Counter(ranks, PATTERN)
    assert counter.counts(texts) == want
    assert [counter(t) for t in texts] == want
    same = Counter({t: r // 2 for t, r in ranks.items()}, PATTERN)  # ranks of two tokens each go one by one
    assert same.counts(texts[:20]) == [one_by_one(same.ranks)(t) for t in texts[:20]]


def test_lines_as_by_the_patterns_alone(spark):
    rng = random.Random(3)
    breaks = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
    texts = [None, "", "\n", "\r\n", "\n\r\n", "a\n\n", "x \x85", *["".join(rng.choice(breaks[:k] + "\nab \xa0 \té") for _ in range(rng.randrange(1, 12))) for k in (1, 2, 10) for _ in range(150)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    by_patterns = F.when(F.length("t") == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("t", f"(?:{text.LINE_BREAK})\\z", ""), text.LINE_BREAK, -1))
    stripped = F.transform(by_patterns, lambda x: F.regexp_replace(x, r"^\p{Z}*\s*|\s*\p{Z}*$", ""))
    rows = df.select("t", text.text_lines(F.col("t")).alias("a"), by_patterns.alias("b"), outline.stripped_lines(F.col("t")).alias("c"), stripped.alias("d")).collect()
    assert len(rows) == len(texts)
    assert [r for r in rows if r.a != r.b or r.c != r.d] == []
