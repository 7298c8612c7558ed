"""Token counts against the library that the vocabulary is of."""

import base64
import random

import pytest

from siftwood.functions.tokens import PATTERN, Counter, merged_length, read_ranks, token_counter

VOCABULARY = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "\n\n  x", "don't we'll I'd", "<|endoftext|> plain", "naïve Ünïcode 漢字かな 🙂🙂", "a" * 5000, "ab" * 4000, " " * 3000 + "end", "x1y2\t\t3.14 -- !!??", "  odd\u0085", "12345678901234567890" * 40]


def test_counts_equal_the_library(spark, vocabulary, library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aeiou tnrs\n'.,é漢1") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string").repartition(3)
    got = {r.id: r.n for r in df.select("id", token_counter(vocabulary)(df.text).alias("n")).collect()}
    assert got.pop(-1) is None
    assert got == {i: len(library.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_whole_documents(spark, sf_dir, vocabulary, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", token_counter(vocabulary)(docs.text).alias("n")).collect()
    assert all(r.n == len(library.encode_ordinary(r.text)) for r in rows if r.text is not None)


def test_merges_in_order_of_rank():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5, b"aa": 6}
    assert merged_length(b"abc", {k: v for k, v in ranks.items() if k != b"abc"}) == 2  # bc comes first, and a is left
    assert [merged_length(w, ranks) for w in (b"abcabc", b"aaa", b"aaaa", b"cba", b"aabc")] == [2, 2, 2, 3, 2]
    assert read_ranks(b"YQ== 0\nYmM= 3\n") == {b"a": 0, b"bc": 3}


def test_the_cache_is_bounded(monkeypatch):
    from siftwood.functions import tokens

    monkeypatch.setattr(tokens, "CACHED_CHARS", 50)
    counter = Counter({b"a": 0}, PATTERN)
    for n in range(1, 200):
        assert counter("a" * n) == n
        assert counter.held <= 50 + tokens.CACHED_WORD


def test_costs_in_tokens(spark, sf_dir, vocabulary, library):
    from siftwood.plans.queries_eval import token_cost_bpe

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        count, lines = lambda t: len(library.encode_ordinary(t)), (r.text or "").removesuffix("\n").split("\n") if r.text else []
        windows = [(i + 1, lines[i : i + 5]) for i in range(0, len(lines), 5) if "".join(lines[i : i + 5]).strip()]
        full, short = sum(count("\n".join(w)) for _, w in windows), sum(count("\n".join([x.strip() for x in w if x.strip()][:2])) for _, w in windows)
        hit = [count("\n".join(w)) for i, w in windows if i <= r.n_chars % 9 + 1 < i + len(w)]
        file = count(r.text or "")
        want.setdefault(r.source, []).append((full + (0 if hit else file), short, short + (hit[0] if hit else file), file, len(hit)))
    mean = lambda rows, i: sum(x[i] for x in rows) // len(rows)
    got = {r.source: (r.n, r.hits, r.full_read, r.outline, r.outline_read, r.file) for r in token_cost_bpe(spark, sf_dir).collect()}
    assert got == {k: (len(v), sum(x[4] for x in v), mean(v, 0), mean(v, 1), mean(v, 2), mean(v, 3)) for k, v in want.items()}
