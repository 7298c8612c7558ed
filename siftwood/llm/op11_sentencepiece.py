"""Operator 11: SentencePiece encoding and decoding of whole texts, with the source bytes of every piece."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import sha256
from .pieces import PieceModel

VOCABULARY = "piece_bpe_32k.model"
#: What a text can give: its ids; the (begin, end) source bytes of each id; the decoded text; digests of these.
OUTPUTS = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string"}
#: Characters of text whose output is held at once.
PART_CHARS = 1_000_000


def coder(path: str) -> PieceModel:
    """One model, and so one cache, per worker process and vocabulary."""
    return common.kept(f"pieces {path}", lambda: PieceModel(path))


def _lists(values: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.empty(0, kind)]).astype(kind)))


def _column(name: str, ids: list[str], decoded: list[str], spans: list[np.ndarray]) -> pa.Array:
    if name == "ids":
        return _lists([np.array(v.split(), np.int32) for v in ids], np.int32)
    if name in ("begins", "ends"):
        return _lists([s[:, int(name == "ends")] for s in spans], np.int64)
    if name == "spans_sha256":
        return pa.array([hashlib.sha256(np.ascontiguousarray(s, "<i8").tobytes()).hexdigest() for s in spans], pa.string())
    values = ids if name == "ids_sha256" else decoded
    return pa.array(values if name == "decoded" else [sha256(v) for v in values], pa.string())


def encode_pieces(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "begins", "ends", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the text column of docs with an end id, and decode the ids: (doc_id, n_tokens, *outputs).

    The spans of an id are bytes of the text in UTF-8, end exclusive; a blank put before the
    text spans nothing of its own, of an unknown character's bytes the last has its span, the
    end id spans the text's end.  spans_sha256 is the SHA-256 of all (begin, end) as
    little-endian 64-bit integers.  A null text counts as empty: the end id alone.  Rows are
    independent, so repeated rows, ties and null ids pass through one to one; other columns
    are not read.  There is no shuffle; memory is one Arrow batch and a bounded cache.
    """
    spans = any(o in ("begins", "ends", "spans_sha256") for o in outputs)

    def run(batches):
        c = coder(path)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, room = at, PART_CHARS
                while end < len(texts) and room > 0:
                    room -= len(texts[end] or "")
                    end += 1
                ids, decoded, counts, placed = zip(*c.encode(texts[at:end], spans), strict=True)
                made = [_column(name, ids, decoded, placed) for name in outputs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(counts, pa.int64()), *made], [id_col, "n_tokens", *outputs])
                at = end

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return common.map_arrow(narrow, run, f"`{id_col}` long, n_tokens long, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs), keeps=f"pieces {path}")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows of ids; null ids count as none.  An id outside the vocabulary is an error."""

    def run(batches):
        c = coder(path)
        for batch in batches:
            texts = [c.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    narrow = encoded.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).cast("array<int>").alias("ids"))
    return common.map_arrow(narrow, run, f"`{id_col}` long, decoded string", keeps=f"pieces {path}")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), ("ids_sha256", "decoded_sha256", "spans_sha256"))
