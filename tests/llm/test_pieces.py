"""Operator 11 against the sentencepiece library."""

import hashlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwood.llm import op11_sentencepiece
from siftwood.llm.pieces import Normaliser, PieceModel

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a", "a  b ", "▁", "▁a▁ b", "\n\n\tx", "x" * 5000, "ab" * 3000, "   " * 50 + "y", "1234567 3.14", "don't ²³ x².", "😀👍🏽 a​b", "漢字かな混じり 文", "\x00\x01", "<s></s><unk>", "é é ﬁ", "Ünïcödé İß", "𐍈𐍈 𞤀", "</s>", "a\r\nb\r\r"]


@pytest.fixture(scope="module")
def both():
    return PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


def byte_spans(text, offsets):
    at = [0, *accumulate(len(c.encode()) for c in text)]
    return [(at[a], at[b]) for a, b in offsets] + [(at[-1], at[-1])]


def check(both, text):
    ours, library = both
    ((ids, decoded, n, spans),) = ours.encode([text])
    want = library.encode(text, add_eos=True)
    assert ids == " ".join(map(str, want)) and n == len(want) and decoded == library.decode(want)
    assert spans.tolist() == [list(s) for s in byte_spans(text, library.encode_as_offset_mapping(text)["offsets"])]
    assert ours.decode(want) == decoded


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    check(both, text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("ab c▁\n.1é", max_size=40))
def test_any_text(both, text):
    check(both, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 270), max_size=12))
def test_any_ids_decode_alike(both, ids):
    assert both[0].decode(ids) == both[1].decode(ids)


RULES = ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"]


@pytest.fixture(scope="module")
def normalisers():
    return {}


@settings(max_examples=200, deadline=None)
@given(st.text("ab 　　ﬁéǺ̀ｱﾞ①㌔​\tA▁Ω", max_size=20) | st.text(max_size=20), st.booleans(), st.booleans(), st.booleans())
@pytest.mark.parametrize("rule", RULES)
def test_compiled_maps_and_alignment(normalisers, rule, text, prefix, escape, squeeze):
    """The longest prefixes of compiled maps, and where each normalised character comes from."""
    key = (rule, prefix, escape, squeeze)
    if key not in normalisers:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=escape, remove_extra_whitespaces=squeeze)
        normalisers[key] = library, Normaliser(library.serialized_normalizer_spec())
    library, ours = normalisers[key]
    want, offsets = library.normalize(text, with_offsets=True)
    got, alignment = ours.normalise(text)
    assert got == want
    if want:
        places = np.array([0, *accumulate(len(c.encode()) for c in got)])
        source = [0, *accumulate(len(c.encode()) for c in text)]
        assert alignment.project(places).tolist() == [source[o] for o in offsets]


def test_map_of_own_rules_takes_the_longest():
    library = sentencepiece.SentencePieceNormalizer(norm_map=[("ab", "X"), ("abcd", "YY Z"), ("b", ""), ("q" * 40, "long")], add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False)
    ours = Normaliser(library.serialized_normalizer_spec())
    for text in ("abcabcdb", "abc", "bbb", "xab", "q" * 39, "q" * 81, "ab" * 30):
        assert ours.normalise(text)[0] == library.normalize(text)


def test_parts_are_cut_where_no_entry_reaches(both):
    model = both[0]
    assert len(model.cut.findall("▁the▁end.\n12")) == 5
    whole = lambda t: model.merge(model.normaliser.normalise(t)[0])
    for text in ("Hello, world! 1+1=2; for (i = 0; i < n; ++i) {\r\n}\r\n", "naïve —  “quotes”  … ², x^{2}"):
        assert whole(text) == [p for part in model.cut.findall(model.normaliser.normalise(text)[0]) for p in model.merge(part)]


def test_merging_together_is_merging_alone(both):
    model = both[0]
    words = ["▁the", "▁onerth", "aaaaaaaa", "abababab", "!!!!!!!!", "▁" * 9, "▁" * 20, "internationalization", "mississippi", "thnd", "x", "ññññ", "▁Straßenbahn"]
    for size in {len(w) for w in words}:
        same = [w for w in words if len(w) == size]
        got = dict(model.merge_equals(same))
        assert got == {w: [model.ids[p] for p in model.merge(w)] for w in same}


def test_other_models_are_refused():
    def field(number, value):
        return bytes([number << 3 | (2 if isinstance(value, bytes) else 0)]) + (bytes([len(value)]) + value if isinstance(value, bytes) else bytes([value]))

    with pytest.raises(ValueError):
        PieceModel(data=field(1, field(1, b"a") + b"\x15\x00\x00\x00\x00") + field(2, field(3, 1)))


def test_frames(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b"), (-3, "same é"), (-3, "same é"), (-4, "lo ng▁ " * 60_000)], "doc_id long, text string"))
    rows = docs.collect()
    encoded = op11_sentencepiece.encode_pieces(docs, PATH, ("ids", "begins", "ends", "decoded", "ids_sha256", "decoded_sha256", "spans_sha256"))
    want = []
    for r in rows:
        text = r.text or ""
        ids = library.encode(text, add_eos=True)
        spans = byte_spans(text, library.encode_as_offset_mapping(text)["offsets"])
        decoded = library.decode(ids)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        packed = b"".join(int(v).to_bytes(8, "little") for s in spans for v in s)
        want.append((r.doc_id, len(ids), ids, [s[0] for s in spans], [s[1] for s in spans], decoded, digest(" ".join(map(str, ids)).encode()), digest(decoded.encode()), digest(packed)))
    assert sorted(str(tuple(r)) for r in encoded.collect()) == sorted(map(str, want))
    again = op11_sentencepiece.decode_pieces(encoded, PATH).collect()
    assert sorted(str(tuple(r)) for r in again) == sorted(str((w[0], w[5])) for w in want)


def test_small_cache_changes_nothing(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    pair = lambda m: [(i, d, n, s.tolist()) for i, d, n, s in m.encode(texts)]
    assert pair(PieceModel(PATH, cache_words=40)) == pair(PieceModel(PATH))


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string, ids int")
    assert op11_sentencepiece.encode_pieces(empty, PATH).count() == 0 and op11_sentencepiece.decode_pieces(spark.createDataFrame([], "doc_id long, ids array<int>"), PATH).count() == 0
    assert op11_sentencepiece.encode_pieces(spark.createDataFrame([(1, "a b", "x", 2)], empty.schema), PATH).first().n_tokens == 3
    assert op11_sentencepiece.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().decoded == ""
