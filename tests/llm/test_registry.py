"""Queries with SQL against their SQL; all queries return what their contracts name."""

import pytest
from conftest import same_rows

from siftwood.llm import registry

COLUMNS = {
    "op1_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op3_": ["query_id", "rank", "vec_id", "score"],
    "op4_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6_": ["doc_id", "source", "n_tokens", "weight", "copies"],
    "op7_": ["doc_id", "fingerprint", "component_id"],
    "op8_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_": ["doc_id", "n_lines", "n_removed", "text_sha256"],
    "op10_": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op12_": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    same_rows(got, want)


@pytest.mark.parametrize("prefix", COLUMNS)
def test_one_query_each_with_its_columns(spark, sf_dir, prefix):
    (name,) = [n for n in registry.QUERIES if n.startswith(prefix)]
    assert registry.QUERIES[name](spark, sf_dir).columns[: len(COLUMNS[prefix])] == COLUMNS[prefix]  # more may follow
