"""Token counts by a table of merge ranks, as a column."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of this kind cut a text before they merge.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over characters up to U+FFFF for the faster engine, which has no \p: L, N and S stand for what the classes hold there.
SPELT = r"'(?:[sdmt]|ll|ve|re)| ?[<L>]+| ?[<N>]+| ?[^<S><L><N>]+|[<S>]+(?![^<S>])|[<S>]+"
#: Characters of the words whose counts a worker keeps, and of the longest word that it keeps.
CACHED_CHARS, CACHED_WORD = 8 << 20, 64
#: Words that are cut from a long text at a time, the characters of such a text, new words that are merged at once, and rows of their table.
CUT_WORDS, LONG_TEXT, NEW_WORDS, SLAB = 100_000, 1 << 20, 50_000, 2_048


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a line of base64 and rank for each token."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merged_length(word: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a word: its bytes, of which the adjacent pair of the lowest rank, the first of equal ones, is joined while there is one.

    A heap holds the pairs, so that a word of any length takes n log n steps; a pair one side
    of which has been joined meanwhile is recognised by its ends and left out.
    """
    if word in ranks:
        return 1
    end = list(range(1, len(word) + 1))  # end of the token that begins at a place; 0 where none does any more
    before = list(range(-1, len(word) - 1))  # where the token before it begins
    heap = [(ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    left = len(word)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if end[i] != mid or mid >= len(word) or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        left -= 1
        if stop < len(word):
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, stop, end[stop]))
        if (j := before[i]) >= 0 and (rank := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (rank, j, i, stop))
    return left


class Merges:
    """merged_length of many short words at once: a row of tokens for each, in which a step joins one pair of every row."""

    def __init__(self, ranks: dict[bytes, int]):
        ids = {token: i for i, token in enumerate(sorted(ranks, key=ranks.__getitem__))}
        for b in range(256):
            ids.setdefault(bytes([b]), len(ids))
        self.none = len(ids)  # beside the ends of a word, and as what a pair makes that isn't joined: above all ids
        made = {}
        for token, i in ids.items():
            for k in range(1, len(token)):
                if (a := ids.get(token[:k])) is not None and (b := ids.get(token[k:])) is not None:
                    made[a * (self.none + 1) + b] = i
        self.pairs = np.array(sorted(made), np.int64)
        self.makes = np.array([made[p] for p in self.pairs.tolist()] + [self.none], np.int64)
        self.pairs = np.append(self.pairs, np.iinfo(np.int64).max)
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        self.of_bytes = self.joined(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * (self.none + 1) + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.makes[at], self.none)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        sizes = np.array([len(w) for w in words], np.int64)
        order, out = np.argsort(sizes, kind="stable"), np.empty(len(words), np.int64)
        for at in range(0, len(words), SLAB):
            some = order[at : at + SLAB]
            out[some] = self._merged([words[i] for i in some.tolist()], sizes[some])
        return out

    def _merged(self, words: list[bytes], left: np.ndarray) -> np.ndarray:
        n, width = len(words), int(left[-1])
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width).astype(np.int64)
        inside = np.arange(width) < left[:, None]
        tokens = np.full((n, width + 2), self.none)
        tokens[:, 1:-1] = np.where(inside, self.of_byte[raw], self.none)
        best = np.full((n, width + 2), self.none)  # what a token makes with the one after it
        best[:, 1:-2] = np.where(inside[:, 1:], self.of_bytes[raw[:, :-1] * 256 + raw[:, 1:]], self.none)
        table, tokens, best = best, tokens.reshape(-1), best.reshape(-1)
        before, after = np.arange(-1, best.size - 1), np.arange(1, best.size + 1)
        left, rows = left.copy(), np.arange(n)
        while True:
            at = (table if rows.size == n else table[rows]).argmin(axis=1) + rows * (width + 2)
            live = best[at] < self.none
            at, rows = at[live], rows[live]
            if not rows.size:
                return left
            token, gone, prior = best[at], after[at], before[at]
            beyond = after[gone]
            tokens[at], after[at], before[beyond], best[gone] = token, beyond, at, self.none
            best[at] = self.joined(token, tokens[beyond])
            best[prior] = self.joined(tokens[prior], token)
            left[rows] -= 1


def spelt(template: str) -> re.Pattern:
    """A pattern over characters up to U+FFFF with the classes as the other engine has them."""
    every = "".join(map(chr, range(0x10000)))
    for name, kind in (("<L>", r"\p{L}"), ("<N>", r"\p{N}"), ("<S>", r"\s")):
        runs = [m.span() for m in regex.finditer(f"{kind}+", every)]
        template = template.replace(name, "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in runs))
    return re.compile(template)


class Known(dict):
    """Counts of words; those that are not among them count 0 and are noted in `new`.

    There are two generations, each of half the bound.  When the younger one is full it
    becomes the older one, whose words come back when they are met again.
    """

    def __init__(self):
        self.older, self.new, self.chars, self.older_chars = {}, [], 0, 0

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            self.new.append(word)
            return 0
        self[word] = n
        self.chars += len(word)
        return n

    def keep(self, found: dict[str, int]) -> None:
        for word, n in found.items():
            if len(word) <= CACHED_WORD:
                self[word] = n
                self.chars += len(word)
        self.new.clear()
        if self.chars > CACHED_CHARS // 2:
            self.older, self.older_chars, self.chars = dict(self), self.chars, 0
            self.clear()


class Counter:
    """Tokens of texts; the lengths of short words are kept, within a bound, from batch to batch."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.cut, self.known = ranks, regex.compile(pattern), Known()
        self.fast = spelt(SPELT) if pattern == PATTERN else None
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        # words are merged by ids in the order of ranks, which needs each rank to be of one token
        self.merges = Merges(ranks) if len(set(ranks.values())) == len(ranks) else None

    @property
    def held(self) -> int:
        return self.known.chars + self.known.older_chars

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text in lists of bounded length; the pattern leaves out nothing of a text, so its matches are the words."""
        cut = self.fast if self.fast and (text.isascii() or not self.beyond(text)) else self.cut
        if len(text) <= LONG_TEXT and not cut.groups:
            yield cut.findall(text)
            return
        found = (m[0] for m in cut.finditer(text))
        while some := list(islice(found, CUT_WORDS)):
            yield some

    def lengths(self, words: list[str]) -> dict[str, int]:
        raw = {w: w.encode() for w in words}
        out = {w: 1 for w, b in raw.items() if b in self.ranks}
        short = [w for w in words if w not in out and len(w) <= CACHED_WORD] if self.merges else []
        if short:
            out.update(zip(short, self.merges.lengths([raw[w] for w in short]).tolist(), strict=True))
        return out | {w: merged_length(b, self.ranks) for w, b in raw.items() if w not in out}

    def counts(self, texts: list[str | None]) -> list[int | None]:
        """Tokens of each text; new words are merged many at a time and added to the texts that have them."""
        known, totals, owed = self.known, [None if t is None else 0 for t in texts], []
        for i, text in enumerate(texts):
            for words in self.words(text or ""):
                if words:
                    totals[i] += sum(map(known.__getitem__, words))
                    owed.append((i, len(known.new)))
                if len(known.new) > NEW_WORDS:
                    self._settle(totals, owed)
        self._settle(totals, owed)
        return totals

    def _settle(self, totals: list[int | None], owed: list[tuple[int, int]]) -> None:
        new, at = self.known.new, 0
        found = self.lengths(list(dict.fromkeys(new)))
        for i, end in owed:
            if end > at:
                totals[i] += sum(map(found.__getitem__, new[at:end]))
            at = end
        owed.clear()
        self.known.keep(found)

    def __call__(self, text: str) -> int:
        return self.counts([text])[0]


def token_counter(path: str | Path, pattern: str = PATTERN):
    """A function from a text column to its count of tokens (long) by the ranks in a file on this host.

    The file, about a megabyte, goes to the workers with the function; executors need not have
    it.  Null has null tokens, the empty text none; strings of special tokens are ordinary text.
    """
    data = Path(path).read_bytes()

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(read_ranks(data), pattern)
        for texts in parts:
            yield pd.Series(counter.counts(list(texts)), dtype="Int64")

    def of(text: Column) -> Column:
        return count(text)

    return of
