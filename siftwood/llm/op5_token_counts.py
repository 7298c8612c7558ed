"""Operator 5: token counts by a map-side two-tier lookup.

Pass 1 finds frequent pre-tokens: every task keeps a bounded Misra-Gries summary of its
rows and emits at most `summary` entries, so what is shuffled is summaries, never the
pre-tokens.  The most frequent `frequent` of them are encoded once and broadcast as a
compact table (joined strings and one byte array of lengths); its size is bounded by the
parameter, whatever the input.  Pass 2 counts: a pre-token is looked up in the table, then
in the worker's own bounded cache, and only new ones are encoded.  The table decides speed
alone; counts are exact without it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import BpeModel, Memory
from .pretoken import is_plain, plain_pattern

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the split pattern of the vocabulary, over plain characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[<L>]+| ?[<N>]+| ?[^<S><L><N>]+|[<S>]+(?![^<S>])|[<S>]+"
FREQUENT, SUMMARY, LONGEST, CACHE = 16_384, 4_096, 48, 400_000


class Counters:
    """Token lengths of pre-tokens: the broadcast tier, and a bounded tier of this worker's own."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.model = BpeModel(path)
        self.library = Tokenizer.from_file(path)
        self.from_byte = {c: b for b, c in self.model.to_byte_chars.items()}
        self.find = plain_pattern(PATTERN).findall
        self.cache = Memory(cache, kept=frequent)

    def words(self, text: str) -> list[str]:
        if is_plain(text):
            return self.find(text)
        back = self.from_byte
        return [bytes([back[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str | None) -> tuple[list[str], int]:
        """The pre-tokens of a text, and the number of special strings in it (a token each)."""
        words, special = [], 0
        for piece, sid in self.model.pieces(text or ""):
            if sid is None:
                words += self.words(piece)
            else:
                special += 1
        return words, special

    def lengths(self, words: list[str]) -> list[int]:
        out = []
        for at in range(0, len(words), 20_000):
            out += map(len, self.model.encode_words(words[at : at + 20_000]))
        return out

    def count(self, texts: list[str | None]) -> Iterable[int]:
        for at in range(0, len(texts), 256):
            cut = [self.split(t) for t in texts[at : at + 256]]
            new = self.cache.missing({w for words, _ in cut for w in words})
            self.cache.update(zip(new, self.lengths(new), strict=True))
            look = self.cache.__getitem__
            for words, special in cut:
                yield sum(map(look, words)) + special


def worker_name(path: str, key: str = "") -> str:
    return f"counts {key} {path}"


def worker(path: str, key: str = "", table=None) -> Counters:
    """One counter, and so one cache, per worker process, vocabulary and broadcast table."""
    return common.kept(worker_name(path, key), lambda: Counters(path, table() if table else None))


def frequent_pretokens(texts: DataFrame, path: str, frequent: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The most frequent pre-tokens of a one-column frame of texts, from one bounded summary per task.

    Any pre-token that makes up more than 1 in `summary` of a task's pre-tokens is in that
    task's summary; ties at the cut go to the smaller string.
    """

    def summarise(batches):
        w, held = worker(path), {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                seen = Counter()
                for t in texts[at : at + 256]:
                    seen.update(w.split(t)[0])
                for k, v in seen.items():
                    held[k] = held.get(k, 0) + v
                if len(held) > 8 * summary:
                    held = _shrink(held, summary)
        held = _shrink(held, summary)
        items = [(k, v) for k, v in held.items() if len(k.encode()) <= LONGEST and "\x00" not in k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.string()), pa.array([v for _, v in items], pa.int64())], ["w", "n"])

    found = common.map_arrow(texts, summarise, "w string, n long", worker_name(path)).groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in found.orderBy(F.desc("n"), "w").limit(frequent).select("w").collect()]


def _shrink(held: dict[str, int], k: int) -> dict[str, int]:
    """Misra-Gries: subtract the (k+1)-th largest count from all and keep the positive rest."""
    if len(held) <= k:
        return held
    cut = sorted(held.values(), reverse=True)[k]
    return {w: n - cut for w, n in held.items() if n > cut}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, summary: int = SUMMARY) -> DataFrame:
    """Token counts of whole texts: (doc_id, n_bytes, n_tokens, over_limit).

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit.  Rows are
    independent: repeated rows, ties and null ids pass through one to one; other columns
    are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    words = frequent_pretokens(narrow.select("text"), path, frequent, summary)
    sizes = Counters(path).lengths(words)
    joined = "\x00".join(words)
    payload = spark.sparkContext.broadcast((joined, bytes(sizes)))
    key = hashlib.sha1(joined.encode()).hexdigest()

    def unpack() -> dict[str, int]:
        joined, lengths = payload.value
        return dict(zip(joined.split("\x00"), lengths, strict=True)) if lengths else {}

    def run(batches):
        w = worker(path, key, unpack)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(list(w.count(texts)), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    out = common.map_arrow(narrow, run, f"`{id_col}` long, n_bytes long, n_tokens long", worker_name(path, key))
    return out.withColumn("over_limit", F.coalesce(F.col("n_tokens") > limit, F.lit(False)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
