"""The queries of this subpackage, and the SQL that expresses some of them."""

from __future__ import annotations

from . import op1_bpe, op2_warc, op3_ann, op4_pii, op10_language, op11_sentencepiece, op12_prefix_trie, op13_repair, op5_token_counts, op6_mixing, op7_simhash, op8_quality, op9_lines

QUERIES = {
    "op1_bpe_encode_decode": op1_bpe.op1_bpe_encode_decode,
    "op2_warc_revisits": op2_warc.op2_warc_revisits,
    "op3_ann_posting_lists": op3_ann.op3_ann_posting_lists,
    "op4_pii_boosting": op4_pii.op4_pii_boosting,
    "op5_token_counts": op5_token_counts.op5_token_counts,
    "op6_source_mixing": op6_mixing.op6_source_mixing,
    "op7_simhash_bktree": op7_simhash.op7_simhash_bktree,
    "op8_quality_rules": op8_quality.op8_quality_rules,
    "op9_line_dedup": op9_lines.op9_line_dedup,
    "op10_language_crf": op10_language.op10_language_crf,
    "op11_sentencepiece": op11_sentencepiece.op11_sentencepiece,
    "op12_prefix_trie": op12_prefix_trie.op12_prefix_trie,
    "op13_structure_repair": op13_repair.op13_structure_repair,
}
ORACLES: dict[str, str] = {
    "op2_warc_revisits": op2_warc.ORACLE,
    "op6_source_mixing": op6_mixing.ORACLE,
    "op8_quality_rules": op8_quality.ORACLE,
    "op9_line_dedup": op9_lines.ORACLE,
    "op12_prefix_trie": op12_prefix_trie.ORACLE,
    "op13_structure_repair": op13_repair.ORACLE,
}
