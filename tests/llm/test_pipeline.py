"""The corpus pipeline, stage by stage, against brute force."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from siftwood.llm import op7_simhash, op9_lines  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_the_documents(spark, sf_dir, tmp_path):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name.replace(" ", "")))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        if name != "tokens":
            assert docs.columns == columns
        if name == "line dedup":
            lines = [tuple(op9_lines.WORDS(x)) for r in docs.collect() for x in r.text.split("\n")]
            lines = [x for x in lines if len(x) >= op9_lines.MIN_WORDS]
            assert len(lines) == len(set(lines)) and all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near copies":
            sets = {r.doc_id: set(op7_simhash.shingles(r.text, 5)) for r in before.collect()}
            ids = sorted(sets)
            least = {i: i for i in ids}

            def find(i):
                return i if least[i] == i else find(least[i])

            for k, a in enumerate(ids):
                for b in ids[:k]:
                    if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        least[y] = x
            assert {r.doc_id for r in docs.collect()} == {i for i in ids if find(i) == i}
        if name == "mixture":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} and docs.count() <= 2 * before.count()
        if name == "tokens":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in docs.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == seen["tokens"].count()


def test_odd_documents(spark, sf_dir, tmp_path):
    text = "the cat sat on the mat and looked at the dog over there"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "12 34", "en", "a", 5), (None, text + " again", "en", "b", 9), (5, text, None, "b", 1), (6, "der Hund und die Katze sind im Haus", "de", "b", 3)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
    assert {r.doc_id for r in docs.collect()} == {1, None, 6}
    empty = spark.createDataFrame([], COLUMNS)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, sf_dir).write.parquet(str(tmp_path / f"e{n}"))
        empty = spark.read.parquet(str(tmp_path / f"e{n}"))
    assert empty.count() == 0


def test_short_and_unspaced_lines_go(spark):
    line = "日本語の文には空白がありません"
    rows = [(1, f"Les.\n\nLes.\n{line}"), (2, f"Les.\nIt is\n{line}\nown words here"), (3, f"it is\nIt  is\n{line[:-1]}ぬ\n東京\n東京"), (None, "Les.")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    want = {1: f"Les.\n\n{line}", 2: "It is\nown words here", 3: "it is\n東京", None: "Les."}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_mixed_and_foreign_documents_go(spark):
    en = "the cat sat on the mat and looked at the dog over there while it was raining in the old town".split()
    de = "der Hund und die Katze sind im Haus und sehen aus dem Fenster auf den Regen in der alten Stadt".split()
    rows = [(i, " ".join(en[i % 5 :] + en[: i % 5]), "en") for i in range(20)] + [(i, " ".join(de[i % 5 :] + de[: i % 5]), "de") for i in range(20, 40)]
    rows += [(100, " ".join(en + de), None), (101, "xqzvk wjqpf zzkq vvbx qqwz jkxv pqzm", None), (102, "съешь же ещё этих мягких французских булок", None), (103, " ".join(en * 4 + de), None), (104, " ".join(de), None)]
    docs = spark.createDataFrame([(i, t, lang, "a", len(t)) for i, t, lang in rows], COLUMNS)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {**{i: lang for i, _, lang in rows if lang}, 103: "en", 104: "de"}
