"""Byte-pair encoding by speculation and verification.

A word is first cut greedily into the longest vocabulary entries.  That proposal
is the true encoding exactly when every adjacent pair of proposed tokens would
stay apart if the pair were encoded alone, and the pair test is a short walk down
the two merge trees, so it runs over all adjacent pairs of a batch of new words in
numpy.  Words with a failing pair are merged exactly, by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable
from functools import cached_property

import numpy as np
import regex

from .pretoken import is_plain, plain_pattern

#: Texts of these characters alone are normalised and split here; others, whose classes differ
#: between Unicode releases, go through the library's own normaliser and splitter.
_COMMON = regex.compile(r"[\u0000-\u052F\u1E00-\u1FFF\u2000-\u2064\u20A0-\u20BF\u2190-\u22FF\u3000-\u3096\u3099-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3]*+")
_NEVER = np.int64(1) << 60
#: Longer words are forgotten after the texts that hold them.
LONG_WORD = 256


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class BpeModel:
    """A byte-level BPE vocabulary, with or without an end-of-word suffix, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.to_byte_chars = {b: c for b, c in enumerate(byte_alphabet())}
        self.max_len = max(map(len, self.vocab))
        size = max(self.vocab.values()) + 1
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left = np.zeros(size, np.int64)
        self.right = np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[x, y] = (r, made)
            self.rank[made], self.left[made], self.right[made] = r, x, y
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.unreachable = self._unreachable()
        self.inner = {s: i for s, i in self.vocab.items() if i not in self.unreachable and not (self.suffix and s.endswith(self.suffix))}
        self.final = {s.removesuffix(self.suffix): i for s, i in self.vocab.items() if i not in self.unreachable and s.endswith(self.suffix)} if self.suffix else self.inner
        self._special_cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")

    def _merge_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or _NEVER."""
        code = x * self.size + y
        at = np.minimum(np.searchsorted(self._keys, code), len(self._keys) - 1)
        return np.where(self._keys[at] == code, self._ranks[at], _NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each token x stays apart from the token y on its right.

        Runs time backwards from the finished pair.  The merge that finished last
        (the right one on equal ranks, since the leftmost goes first) is undone,
        and a merge across the gap must not have had its turn before it.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        ok = np.ones(len(x), bool)
        limit = np.full(len(x), _NEVER) if limit is None else limit.astype(np.int64)
        live = np.arange(len(x))
        while len(live):
            bad = self._merge_rank(x, y) < limit
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_x = rx > ry
            limit = np.where(undo_x, rx, ry + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def _unreachable(self) -> set[int]:
        """Tokens whose own string is encoded as something else; greedy matching must not propose them."""
        made = np.flatnonzero(self.rank >= 0)
        bad = set(made[~self.compatible(self.left[made], self.right[made], self.rank[made])].tolist())
        for t in made[np.argsort(self.rank[made])].tolist():
            if int(self.left[t]) in bad or int(self.right[t]) in bad:
                bad.add(t)
        return bad

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the byte characters of a word."""
        inner, final, longest = self.inner, self.final, self.max_len
        out, i, n = [], 0, len(word)
        while i < n:
            if n - i <= longest and (t := final.get(word[i:])) is not None:
                out.append(t)
                break
            j = min(n - 1 if self.suffix else n, i + longest)
            while (t := inner.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge_exactly(self, word: str) -> list[int]:
        """The defining procedure: repeatedly join the lowest-ranked adjacent pair, leftmost first."""
        tokens = [self.vocab[c] for c in word]
        if self.suffix:
            tokens[-1] = self.vocab[word[-1] + self.suffix]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(m[0], i, tokens[i], tokens[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, tokens[k])):
                    heapq.heappush(heap, (m[0], i, made, tokens[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((tokens[h], made))):
                heapq.heappush(heap, (m[0], h, tokens[h], made, m[1]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (a pre-token as text): propose all, test all pairs, merge the failing words."""
        table = self.to_byte_chars
        mapped = [w.encode().decode("latin-1").translate(table) for w in words]
        out = [self.propose(w) for w in mapped]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(sizes.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(out)), sizes)
            at = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, where = np.unique(flat[at] * self.size + flat[at + 1], return_inverse=True)
            ok = self.compatible(pairs // self.size, pairs % self.size)[where]
            for i in np.unique(owner[at[~ok]]).tolist():
                out[i] = self.merge_exactly(mapped[i])
        return out

    def pieces(self, text: str) -> Iterable[tuple[str, int | None]]:
        """The text between special strings, and the special ids, in order."""
        if not any(s in text for s in self.special):
            yield text, None
            return
        at = 0
        for m in self._special_cut.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None


class Memory(dict):
    """What is known of words, bounded in words and characters; of long words until the next call alone.  What is `kept` stays."""

    def __init__(self, words: int, chars: int = 4_000_000, kept: dict | None = None):
        super().__init__(kept or {})
        self.kept, self.words, self.chars = kept or {}, words + len(kept or {}), chars
        self.used, self.passing = 0, []

    def missing(self, words: set[str]) -> list[str]:
        """Those of the words that are not known, for which there is room now."""
        for w in self.passing:
            self.pop(w, None)
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.words or self.used + sum(map(len, new)) > self.chars:
            self.clear()
            self.update(self.kept)
            self.used, new = 0, [w for w in words if w not in self]
        self.passing = [w for w in new if len(w) > LONG_WORD]
        self.used += sum(map(len, new)) - sum(map(len, self.passing))
        return new


class WordBpe:
    """The lower-casing word vocabulary: text to ids and back, as the library does for the same file."""

    #: The file's own split pattern, with white space spelt out, and the same over plain characters.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
    PLAIN = plain_pattern(r"'s|'t|'re|'ve|'m|'ll|'d|[<L>]+|[<N>]|[^<S><L><N>]+")

    def __init__(self, path: str, cache_words: int = 120_000):
        self.model = BpeModel(path)
        self.from_byte_char = {c: b for b, c in enumerate(byte_alphabet())}
        self.cache = Memory(cache_words)  # word to ids, names and their number

    @cached_property
    def library(self):
        """The library's own tokenizer, read at the first text that needs its normaliser."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.model.path)

    def words(self, text: str) -> list[str]:
        """Pre-tokens in NFC and lower case; white space only separates, so runs of it need no collapsing."""
        if text.isascii():
            return self.PLAIN.findall(text.lower())
        if is_plain(text):
            # composing and lower-casing may leave the plain characters (a mark after a letter, a capital I with a dot)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            return (self.PLAIN if is_plain(text) else self.SPLIT).findall(text)
        if _COMMON.fullmatch(text):
            return self.SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        back = self.from_byte_char
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([back[c] for c in w]).decode() for w, _ in cut]

    def learn(self, words: set[str]) -> None:
        new, names = self.cache.missing(words), self.model.names
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, ids in zip(part, self.model.encode_words(part), strict=True):
                self.cache[w] = (" ".join(map(str, ids)), " ".join([names[i] for i in ids]), len(ids))

    def encode(self, texts: list[str | None]) -> Iterable[tuple[str, str, int]]:
        """Per text: its ids joined by spaces, the decoded text, the number of tokens."""
        for at in range(0, len(texts), 256):
            cut = []
            for text in texts[at : at + 256]:
                parts = []
                for piece, special in self.model.pieces(text or ""):
                    if special is None:
                        parts.append((self.words(piece), None))
                    else:
                        parts.append((piece, special))
                cut.append(parts)
            self.learn({w for parts in cut for words, special in parts if special is None for w in words})
            look = self.cache.__getitem__
            for parts in cut:
                got = []
                for words, special in parts:
                    got += map(look, words) if special is None else [(str(special), words, 1)]
                ids, names, counts = zip(*got, strict=True) if got else ((), (), ())
                yield " ".join(ids), " ".join(names), sum(counts)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
