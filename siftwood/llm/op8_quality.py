"""Operator 8: quality rules with suffix-array repetition.

The words of many texts are laid end to end, each text in an alphabet of its own, and one
suffix array is built for all by prefix doubling (only suffixes that are still tied are
sorted again).  Neighbours in the suffix array with a longest common prefix of `min_repeat`
words or more bound the LCP intervals, that is, the maximal repeated substrings; the union
of their spans gives the covered fraction, and the largest prefix the longest repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"
#: A repeat counts from this many words on; at most this share of the words may lie in repeats, and none may be longer.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 10, 0.4, 100
BATCH_WORDS = 400_000


class Repeats:
    """Repeated word sequences within each of several texts, given as word ids and sizes."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        self.n, self.sizes = n, sizes = len(ids), sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        first = self.doc * (int(ids.max()) + 1 if n else 1) + ids
        self.order = np.argsort(first, kind="stable")
        # levels[j][i]: order of the 2^j words from i on; equal where those words are.  Half-size numbers where they do, as a
        # text that repeats itself over and over has a level for each doubling of its longest repeat
        self.levels: list[np.ndarray] = []
        kind = np.int32 if n < 1 << 31 else np.int64
        rank = np.empty(n, kind)
        ordered = first[self.order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if n else np.empty(0, np.int64)
        rank[self.order] = np.repeat(starts, np.diff(np.r_[starts, n]))
        self.levels.append(rank)
        counts = np.diff(np.r_[starts, n])
        slots = np.flatnonzero(np.repeat(counts > 1, counts))
        step = 1
        while len(slots):
            rank = rank.copy()
            at = self.order[slots]
            then = at + step
            key = self.levels[-1][at] * np.int64(n + 1)
            key += np.where(then < self.end[at], self.levels[-1][np.minimum(then, n - 1)] + 1, 0)
            again = np.argsort(key, kind="stable")
            at, key = at[again], key[again]
            self.order[slots] = at
            new = np.r_[True, key[1:] != key[:-1]]
            starts = np.flatnonzero(new)
            counts = np.diff(np.r_[starts, len(key)])
            rank[at] = np.repeat(slots[starts], counts)
            self.levels.append(rank)
            slots = slots[np.repeat(counts > 1, counts)]
            step *= 2

    def per_doc(self, marked: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[marked], minlength=len(self.sizes))

    def in_windows(self) -> np.ndarray:
        """Words of each text in 3-word windows that occur in it twice or more."""
        marked = np.zeros(self.n + 1, bool)
        if self.n and len(self.levels) > 1:
            at = np.flatnonzero(np.arange(self.n) + 2 < self.end)
            key = self.levels[1][at] * np.int64(self.n + 1) + self.levels[0][at + 2]
            _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
            at = at[counts[where] > 1]
            for k in range(3):
                marked[at + k] = True
        return self.per_doc(marked[: self.n])

    def spans(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the longest repeat from each position where it has at least `least` words."""
        low = min(len(self.levels) - 1, least.bit_length() - 1)
        held = self.levels[low][self.order]
        tied = np.flatnonzero(held[1:] == held[:-1])
        p, q = self.order[tied].copy(), self.order[tied + 1].copy()
        a, b, lcp = p.copy(), q.copy(), np.zeros(len(tied), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            inside = (a < self.end[p]) & (b < self.end[q])
            same = inside & (self.levels[j][np.minimum(a, self.n - 1)] == self.levels[j][np.minimum(b, self.n - 1)])
            lcp += same * (1 << j)
            a, b = a + same * (1 << j), b + same * (1 << j)
        best = np.zeros(self.n, np.int64)
        np.maximum.at(best, p, lcp)
        np.maximum.at(best, q, lcp)
        at = np.flatnonzero(best >= least)
        return at, best[at]

    def covered(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text: words in the union of repeats of `least` words or more, and the longest such repeat."""
        if not self.n:
            return np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        at, length = self.spans(least)
        delta = np.zeros(self.n + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + length, -1)
        longest = np.zeros(len(self.sizes), np.int64)
        np.maximum.at(longest, self.doc[at], length)
        return self.per_doc(np.cumsum(delta[:-1]) > 0), longest


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    seen = [x for x in lines if x.strip("\t\n\v\f\r ")]
    return len(seen) - len(set(seen))


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The figures of each text."""
    texts = [t or "" for t in texts]
    words = [WORDS(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    ids = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.empty(0, np.int64)
    r = Repeats(ids, sizes)
    covered, longest = r.covered(min_repeat)
    return {
        "n_words": sizes,
        "word_chars": np.array([sum(map(len, ws)) for ws in words], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": r.in_windows().astype(np.int64),
        "covered_words": covered.astype(np.int64),
        "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition figures and the verdict of each text.

    Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    covered_words, longest_repeat, base_failed, kept); longest_repeat is 0 if no repeat has
    min_repeat words.  kept is false where base_failed, or
    where repeats of min_repeat words or more cover over max_covered of the words, or one is
    longer than max_repeat words.  A null or empty text has no words, so it fails.  Rows are
    independent: repeated rows, ties and null ids pass through one to one; other columns are
    not read.  No shuffle; memory is bounded by BATCH_WORDS plus one text.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, room = at, BATCH_WORDS * 6
                while end < len(texts) and room > 0:
                    room -= len(texts[end] or "")
                    end += 1
                got = measure(texts[at:end], min_repeat)
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *(pa.array(got[k], pa.int64()) for k in names)], [id_col, *names])
                at = end

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    out = common.map_arrow(narrow, run, f"`{id_col}` long, " + ", ".join(f"{k} long" for k in names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_repeat)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(common.table(spark, sf_dir, "documents")).select(*named, "covered_words", "longest_repeat")


#: A word is covered exactly when it lies in a repeated window of min_repeat words, and a repeat is
#: longer than max_repeat exactly when a window of max_repeat + 1 words occurs twice.  The longest repeat is the
#: longest run of places i at which the ten words from i and from i + d are the same, for one distance d, and nine words more.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w[i:i+2] AS g3, CASE WHEN i + 9 <= len(w) THEN hash(w[i:i+9]) END AS g10, CASE WHEN i + 100 <= len(w) THEN hash(w[i:i+100]) END AS g101, i + 2 <= len(w) AS in3 FROM p),
c AS (SELECT doc_id, i, in3 AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3,
             g10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g10) > 1 AS r10,
             g101 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g101) > 1 AS r101 FROM g),
m AS (SELECT doc_id, max(r3::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS in3,
             max(r10::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS in10, r101::INT AS r101 FROM c),
s AS (SELECT doc_id, sum(in3) AS n3, sum(in10) AS n10, max(r101) AS long FROM m GROUP BY doc_id),
q AS (SELECT a.doc_id, a.i, b.i - a.i AS d FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.g10 = b.g10 AND a.i < b.i),
t AS (SELECT doc_id, 9 + max(n) AS longest FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, d, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS run FROM q) GROUP BY doc_id, d, run) GROUP BY doc_id),
l AS (SELECT doc_id, sum(n - 1) AS dup FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
       coalesce(n3, 0)::BIGINT AS n_repeat_words, coalesce(n10, 0)::BIGINT AS covered_words,
       len(w) < 50 OR 100 * coalesce(n3, 0) > 50 * len(w) AS base_failed,
       NOT (len(w) < 50 OR 100 * coalesce(n3, 0) > 50 * len(w)) AND coalesce(n10, 0) <= 0.4 * len(w) AND coalesce(long, 0) = 0 AS kept, coalesce(longest, 0)::BIGINT AS longest_repeat
FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
