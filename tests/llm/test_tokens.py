"""Operators 1 and 5 against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwood.llm import op1_bpe, op5_token_counts
from siftwood.llm.bpe import BpeModel, WordBpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a<|endoftext|>B", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "İstanbul ẞ ǅ", "é é ﬁ", "x" * 5000, "1234567", "don't I'LL we've", "a b c\x1cd\x85e​f", "😀👍🏽", "ab\n\n  cd \t", "漢字かな", "՘֋ 𞤀", "|||| ---- ****", "\x00�"]


@pytest.fixture(scope="module")
def word():
    return WordBpe(WORD), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return op5_token_counts.Counters(BYTE), Tokenizer.from_file(BYTE)


def check_word(word, text):
    ours, library = word
    ids, decoded, n = next(iter(ours.encode([text])))
    e = library.encode(text, add_special_tokens=False)
    assert ids == " ".join(map(str, e.ids)) and n == len(e.ids) and decoded == library.decode(e.ids, skip_special_tokens=False)


def check_byte(byte, text):
    ours, library = byte
    assert next(iter(ours.count([text]))) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(word, byte, text):
    check_word(word, text)
    check_byte(byte, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(word, byte, text):
    check_word(word, text)
    check_byte(byte, text)


def test_every_code_point_of_the_first_planes(word, byte):
    for cp in [*range(0x600), *range(0x600, 0x30000, 53)]:
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            check_word(word, f"A{c}B {c}{c}c 1{c} Σ{c}")
            check_byte(byte, f"A{c}B  {c}c 1{c} {c}")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_speculation_agrees_with_merging(path):
    model = BpeModel(path)
    words = ["the", "onerth", "aaaaaaa", "ababab", "einungtion", "zzzqqq", "internationalization", "ooooo", "mississippi", "ééaux"] + ["ab" * n for n in range(1, 20)]
    table = model.to_byte_chars
    exact = [model.merge_exactly(w.encode().decode("latin-1").translate(table)) for w in words]
    assert model.encode_words(words) == exact
    # some proposals fail and some stand, or the test would show nothing
    proposed = [model.propose(w.encode().decode("latin-1").translate(table)) for w in words]
    assert 0 < sum(a == b for a, b in zip(proposed, exact, strict=True)) < len(words)


def test_small_caches_change_nothing(sf_dir, spark):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    assert list(WordBpe(WORD, cache_words=50).encode(texts)) == list(WordBpe(WORD).encode(texts))
    assert list(op5_token_counts.Counters(BYTE, {" the": 1}, cache=50).count(texts)) == list(op5_token_counts.Counters(BYTE).count(texts))


def test_frames(spark, sf_dir):
    library_w, library_b = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "same"), (-3, "same")], "doc_id long, text string"))
    rows = docs.collect()
    got = sorted(op1_bpe.encode_texts(docs, WORD, ("ids", "decoded", "ids_sha256", "decoded_sha256")).collect(), key=str)
    want = []
    for r in rows:
        e = library_w.encode(r.text or "", add_special_tokens=False)
        decoded = library_w.decode(e.ids, skip_special_tokens=False)
        want.append((r.doc_id, len(e.ids), e.ids, decoded, hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    counts = op5_token_counts.count_tokens(docs, BYTE, limit=100, frequent=64, summary=32)
    n = lambda r: len(library_b.encode(r.text or "", add_special_tokens=False).ids)
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(str((r.doc_id, len((r.text or "").encode()), n(r), n(r) > 100)) for r in rows)


def test_frequent_words_are_found_in_bounded_summaries(spark):
    texts = spark.createDataFrame([(f"hot cold hot w{i} hot",) for i in range(400)], "text string").repartition(3)
    assert op5_token_counts.frequent_pretokens(texts, BYTE, frequent=2, summary=8)[0] == " hot"


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string, own int")
    assert op1_bpe.encode_texts(empty, WORD).count() == 0 and op5_token_counts.count_tokens(empty, BYTE).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 2)], empty.schema)
    assert op1_bpe.encode_texts(clash, WORD).first().n_tokens == 2 and op5_token_counts.count_tokens(clash, BYTE).first().n_tokens == 2
