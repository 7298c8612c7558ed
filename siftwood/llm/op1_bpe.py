"""Operator 1: BPE encoding and decoding of whole texts."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import WordBpe, sha256

VOCABULARY = "word_bpe_49k.json"


def coder(path: str) -> WordBpe:
    """One coder, and so one word cache, per worker process and vocabulary."""
    return common.kept(path, lambda: WordBpe(path))


#: What a text can give: its ids, the decoded text, and the SHA-256 of the space-joined ids and of the decoded text.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
#: Characters of text whose output is held at once.
PART_CHARS = 1_000_000


def _column(name: str, values: list[str]) -> pa.Array:
    """An output column of the joined ids or the decoded texts of a part."""
    if name == "ids":
        parts = [np.array(v.split(), np.int32) for v in values]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int32)])))
    return pa.array(values if name == "decoded" else [sha256(v) for v in values], pa.string())


def encode_texts(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode the text column of docs: (doc_id, n_tokens, *outputs).

    Digests are made where the values are, so that those need not leave the worker.
    A null text counts as empty: no tokens, empty decoded text.  Rows are independent, so
    repeated rows, ties and null ids pass through one to one; other columns are not read.
    There is no shuffle; memory is one Arrow batch and a bounded word cache.
    """

    def run(batches):
        c = coder(path)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, room = at, PART_CHARS
                while end < len(texts) and room > 0:
                    room -= len(texts[end] or "")
                    end += 1
                ids, decoded, counts = zip(*c.encode(texts[at:end]), strict=True)
                made = [_column(name, ids if name.startswith("ids") else decoded) for name in outputs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(counts, pa.int64()), *made], [id_col, "n_tokens", *outputs])
                at = end

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(narrow, run, f"`{id_col}` long, n_tokens long, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs), keeps=path)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), ("ids_sha256", "decoded_sha256"))
