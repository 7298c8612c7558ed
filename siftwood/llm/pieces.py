"""SentencePiece byte-pair models: files, normalisation with source alignment, encoding, decoding.

A text is normalised by the longest prefix that the model's compiled character map knows, and
every change of length is noted as an event (where it lies in the source and in the normalised
text, in bytes).  Piece boundaries are then projected through the events to byte spans of the
source.  The normalised text is cut where no vocabulary entry can reach across, so each part is
merged by itself, once a worker.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

from .bpe import Memory
from .pretoken import class_of

#: The sign that stands for a blank, the text of an unknown id, the kinds of entries in a model file.
BLANK, UNKNOWN_TEXT = "▁", " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Parts of up to so many characters are merged together, length by length; characters that the cache of parts holds.
TOGETHER, CACHE_CHARS = 64, 6_000_000
_NEVER = (1 << 31) - 1
_WIDE = len(BLANK.encode())


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """The compiled character map of a model: a double-array trie of byte strings, and what each becomes."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :]
        self._pairs: dict[str, bool] = {}

    def _walk(self, key: bytes) -> tuple[int, int, bool]:
        """(length, place in strings) of the longest entry that key begins with, length 0 if none; and whether key ends inside the trie."""
        units, at, found, value = self.units, 0, 0, 0
        at ^= self._offset(units[0])
        for n, b in enumerate(key, 1):
            at ^= b
            if at >= len(units) or units[at] & 0x800000FF != b:
                return found, value, False
            unit = units[at]
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found, value = n, units[at] & 0x7FFFFFFF
        return found, value, True

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def matches(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(begin, end, what it becomes) of the longest entries, from the left, without overlap; places in characters."""
        if not self.units:
            return
        # a character, or two, that the trie has no way for cannot begin an entry: looked up once for all texts
        pairs, at, n = self._pairs, 0, len(text)
        if len(pairs) > 200_000:
            pairs.clear()
        while at < n:
            pair = text[at : at + 2]
            may = pairs.get(pair)
            if may is None:
                length, _, inside = self._walk(pair.encode())
                may = pairs[pair] = length > 0 or inside
            if may:
                # entries are short; a longer stretch is read only while the trie goes on
                size, inside = 16, True
                while True:
                    length, value, inside = self._walk(text[at : at + size].encode())
                    if not inside or at + size >= n:
                        break
                    size *= 4
                if length:
                    end = at + len(text[at : at + size].encode()[:length].decode())
                    yield at, end, self.strings[value : self.strings.index(0, value)].decode()
                    at = end
                    continue
            at += 1


class Alignment:
    """Where a normalised text comes from: events of differing length; between them bytes correspond one to one."""

    def __init__(self, begins, ends, from_begins, from_ends, size: int, source_end: int):
        self.begins, self.ends, self.from_begins, self.from_ends = (np.asarray(a, np.int64) for a in (begins, ends, from_begins, from_ends))
        self.size, self.source_end = size, source_end

    def project(self, places: np.ndarray) -> np.ndarray:
        """Source bytes of byte places of the normalised text: an event's begin for all places inside it."""
        at = np.searchsorted(self.begins, places, "right") - 1
        near = np.maximum(at, 0)
        if len(self.begins):
            inside = places < self.ends[near]
            out = np.where(inside, self.from_begins[near], self.from_ends[near] + places - self.ends[near])
            out = np.where(at < 0, places, out)
        else:
            out = places.copy()
        out[places >= self.size] = self.source_end
        return out


class Normaliser:
    """Normalisation as the model file specifies, with the alignment to the source."""

    def __init__(self, spec: bytes = b"", suffix: bool = False):
        f = dict(_fields(spec))
        self.map = CharacterMap(f.get(2, b""))
        self.prefix, self.squeeze, self.escape, self.suffix = (bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1)), suffix)

    def normalise(self, text: str) -> tuple[str, Alignment]:
        if not text:
            return "", Alignment([], [], [], [], 0, 0)
        found = self.map.matches(text)
        first = next(found, None)
        if first is None and not self.squeeze and self.escape and self.prefix and not self.suffix:
            return self._plain(text)
        return self._general(text, [first, *found] if first else [])

    @staticmethod
    def _plain(text: str) -> tuple[str, Alignment]:
        """The common case: nothing is mapped, only blanks change, and one is put before."""
        raw = np.frombuffer(text.encode(), np.uint8)
        blanks = np.flatnonzero(raw == 32)
        begins = blanks + np.arange(1, len(blanks) + 1) * (_WIDE - 1) + 1
        out = BLANK + text.replace(" ", BLANK)
        whole = lambda first, rest: np.concatenate([[first], rest])
        return out, Alignment(whole(0, begins), whole(_WIDE, begins + _WIDE), whole(0, blanks), whole(0, blanks + 1), len(raw) + (len(blanks) + 1) * (_WIDE - 1) + 1, len(raw))

    def _general(self, text: str, mapped: list[tuple[int, int, str]]) -> tuple[str, Alignment]:
        blank = BLANK if self.escape else " "
        events: list[tuple[int, int, int, int]] = []
        out: list[str] = []
        place = source = 0
        seen_blank = self.squeeze

        def put(piece: str, begin: int, end: int) -> None:
            nonlocal place
            piece = piece.replace(" ", blank)
            size = len(piece.encode())
            events.append((place, place + size, begin, end))
            out.append(piece)
            place += size

        def aligned(size: int, source_end: int) -> Alignment:
            return Alignment(*(zip(*events, strict=True) if events else ([], [], [], [])), size, source_end)

        # blanks are changed like mapped characters
        taken = iter([*mapped, (len(text), len(text), "")])
        changes, at = [], 0
        for begin, end, became in taken:
            changes += [(m.start(), m.end(), " ") for m in re.compile(" ").finditer(text, at, begin)]
            changes.append((begin, end, became))
            at = end
        changes.pop()
        # what comes before the first character that is not a blank goes, if blanks are squeezed
        lead = 0
        if self.squeeze:
            while lead < len(changes) and changes[lead][2] == " " and (changes[lead][0] == (changes[lead - 1][1] if lead else 0)):
                lead += 1
            skipped = changes[lead - 1][1] if lead else 0
        else:
            skipped = 0
        source = len(text[:skipped].encode())
        if skipped == len(text):
            return "", Alignment([], [], [], [], 0, 0)
        at = skipped
        if self.prefix and not self.suffix:
            put(" ", source, source)
        elif source:
            events.append((0, 0, 0, source))
        for begin, end, became in [*changes[lead:], (len(text), len(text), None)]:
            if begin > at:
                plain = text[at:begin]
                size = len(plain.encode())
                out.append(plain)
                place, source, seen_blank = place + size, source + size, False
            if became is None:
                break
            size = len(text[begin:end].encode())
            kept = became.lstrip(" ") if seen_blank else became
            put(kept, source, source + size)
            if kept:
                seen_blank = kept.endswith(" ") and self.squeeze
            elif not self.squeeze:
                seen_blank = False
            source, at = source + size, end
        made, last = "".join(out), source
        if self.squeeze:
            while made.endswith(blank):
                made = made[: -len(blank)]
                place -= len(blank.encode())
                last = int(aligned(1 << 60, source).project(np.array([place]))[0])
        if self.suffix and self.prefix:
            begin = place
            made += blank
            place += len(blank.encode())
            events = [e for e in events if e[0] < begin] + [(begin, place, last, last)]
        return made, aligned(place, last)


class PieceModel:
    """A byte-pair SentencePiece model with byte fallback.

    Models of other kinds (unigram, without byte fallback, with user-defined or unused
    entries, entries of over 255 bytes) are refused: their rules are others.
    """

    def __init__(self, path: str | None = None, cache_words: int = 250_000, data: bytes | None = None):
        if data is None:
            with open(path, "rb") as f:
                data = f.read()
        self.pieces, self.kinds, self.score = [], [], {}
        trainer, spec = {}, b""
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.kinds.append(f.get(3, NORMAL))
                if self.kinds[-1] == NORMAL:
                    self.score[self.pieces[-1]] = struct.unpack("<f", f[2])[0]
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = value
        if trainer.get(3) != 2 or not trainer.get(35) or not set(self.kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BLANK not in self.score or any(len(p.encode()) > 255 for p in self.score):
            raise ValueError("a byte-pair model with byte fallback is needed")
        self.normaliser = Normaliser(spec, bool(trainer.get(24)))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.end = self.pieces.index((trainer.get(47) or b"</s>").decode())
        self.names, self.sizes = [str(i) for i in range(len(self.pieces))], [len(p.encode()) for p in self.pieces]
        self.texts = [p.replace(BLANK, " ") for p in self.pieces]
        self._pairs()
        self.cut = self._cut()
        self.cache = Memory(cache_words, CACHE_CHARS)  # part to ids, decoded text, number of ids, bytes of each piece

    def _pairs(self) -> None:
        """Tables of the characters and of all pairs that join: what they become, and their turn (equal scores share one)."""
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        turn = {s: n for n, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        found = {}
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                x, y = self.ids.get(p[:at]), self.ids.get(p[at:])
                if x is not None and y is not None:
                    found[x * len(self.pieces) + y] = (turn[self.score[p]], i)
        self.pair_keys = np.array([*sorted(found), 1 << 62], np.int64)
        self.pair_turns, self.pair_ids = np.array([*(found[k] for k in sorted(found)), (_NEVER, 0)], np.int32).T.copy()

    def _look(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The turns of pairs of ids, _NEVER if they do not join, and what they become."""
        key = x.astype(np.int64) * len(self.pieces) + y
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_turns[at], _NEVER), self.pair_ids[at]

    def _cut(self) -> re.Pattern:
        """The finest of these patterns whose cuts no vocabulary entry reaches across."""
        letters = class_of("L")
        for pattern in (f"{BLANK}*[{letters}]+|{BLANK}*[0-9]|{BLANK}*[^{BLANK}0-9{letters}]+|{BLANK}+", f"{BLANK}*[^{BLANK}]+|{BLANK}+"):
            made = re.compile(pattern)
            if all(made.fullmatch(p) and len(made.findall(p)) == 1 for p in self.score):
                return made
        return re.compile(r"[\s\S]+")

    def merge(self, part: str) -> list[str]:
        """Join the best adjacent pair, the leftmost of equals, until no pair is an entry."""
        held: list[str | None] = list(part)
        n, score = len(held), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a, j = held[i], after[i]
            if a is None or j >= n or len(a) + len(held[j]) != size:
                continue
            held[i], held[j] = a + held[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(held[i] + held[k])) is not None:
                    heapq.heappush(heap, (-s, i, size + len(held[k])))
            if (h := before[i]) >= 0 and (s := score.get(held[h] + held[i])) is not None:
                heapq.heappush(heap, (-s, h, len(held[h]) + size))
        return [p for p in held if p is not None]

    def merge_equals(self, parts: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(part, ids) of parts of one length: all take their next merge at once, so their lengths stay equal until they end.

        Parts with characters that are no entries are left out.
        """
        held = self.char_ids[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)].reshape(len(parts), -1)
        rows = np.flatnonzero((held >= 0).all(1))
        held = held[rows]
        turns, made = self._look(held[:, :-1], held[:, 1:])
        while len(rows):
            width = held.shape[1]
            if width > 1:
                place = turns.argmin(1)
                ended = turns[np.arange(len(rows)), place] == _NEVER
            else:
                ended = np.ones(len(rows), bool)
            if ended.any():
                yield from zip([parts[r] for r in rows[ended].tolist()], held[ended].tolist(), strict=True)
                going = ~ended
                rows, held, turns, made = rows[going], held[going], turns[going], made[going]
                if not len(rows):
                    return
                place = place[going]
            each, right = np.arange(len(rows)), np.arange(width - 1)
            held[each, place] = made[each, place]
            held = np.take_along_axis(held, right + (right > place[:, None]), 1)
            pairs = right[: width - 2]
            pairs = pairs + (pairs >= place[:, None])
            turns, made = np.take_along_axis(turns, pairs, 1), np.take_along_axis(made, pairs, 1)
            for on, at in ((place > 0, place - 1), (place < width - 2, place)):
                w, c = each[on], at[on]
                turns[w, c], made[w, c] = self._look(held[w, c], held[w, c + 1])

    def learn(self, parts: set[str]) -> None:
        new = self.cache.missing(parts)
        by_length: dict[int, list[str]] = {}
        for part in new:
            by_length.setdefault(len(part), []).append(part)
        cache, names, texts, sizes = self.cache, self.names.__getitem__, self.texts.__getitem__, self.sizes.__getitem__
        for length, some in by_length.items():
            for at in range(0, len(some), 20_000) if length <= TOGETHER else ():
                for part, ids in self.merge_equals(some[at : at + 20_000]):
                    cache[part] = (" ".join(map(names, ids)), "".join(map(texts, ids)), len(ids), bytes(map(sizes, ids)))
        for part in new:
            if part not in cache:
                ids, spans = [], []
                for p in self.merge(part):
                    raw = p.encode()
                    if p in self.ids:
                        ids.append(self.ids[p])
                        spans.append(len(raw))
                    else:  # an unknown character becomes its bytes, of which the last has the whole span
                        ids += [self.byte_ids[b] for b in raw]
                        spans += [0] * (len(raw) - 1) + [len(raw)]
                cache[part] = (" ".join(map(names, ids)), self._plain_text(ids), len(ids), bytes(spans))

    def _plain_text(self, ids: list[int]) -> str:
        """The text of ids, a blank before it included."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_lenient(raw))
                raw = bytearray()
            kind = self.kinds[i]
            out.append("" if kind == CONTROL else UNKNOWN_TEXT if kind == UNKNOWN else self.pieces[i].replace(BLANK, " "))
        if raw:
            out.append(_lenient(raw))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: control ids give nothing, the first blank of the first piece that gives text goes if normalising adds one.

        Runs of bytes are read as UTF-8; a byte that fits nowhere becomes U+FFFD.
        """
        ids = list(ids)
        first = next((n for n, i in enumerate(ids) if self.kinds[i] != CONTROL), len(ids))
        text = self._plain_text(ids[first:])
        own = first < len(ids) and self.kinds[ids[first]] == NORMAL and self.pieces[ids[first]].startswith(BLANK)
        if not own or not (self.normaliser.prefix or self.normaliser.squeeze):
            return text
        return text.lstrip(" ") if self.normaliser.squeeze else text[1:]

    def encode(self, texts: list[str | None], spans: bool = True) -> Iterator[tuple[str, str, int, np.ndarray | None]]:
        """Per text: its ids joined by blanks, an end id last; the text these decode to; their number; the (begin, end) source bytes of each."""
        for at in range(0, len(texts), 128):
            made = [self.normaliser.normalise(t or "") for t in texts[at : at + 128]]
            cut = [self.cut.findall(m) for m, _ in made]
            self.learn({p for parts in cut for p in parts})
            look = self.cache.__getitem__
            for parts, (_, alignment) in zip(cut, made, strict=True):
                ids, decoded, counts, sizes = zip(*map(look, parts), strict=True) if parts else ((), (), (), ())
                text = "".join(decoded)
                if text and parts[0].startswith(BLANK) and (self.normaliser.prefix or self.normaliser.squeeze):
                    text = text.lstrip(" ") if self.normaliser.squeeze else text[1:]
                placed = None
                if spans:
                    ends = np.cumsum(np.frombuffer(b"".join(sizes), np.uint8), dtype=np.int64)
                    bounds = alignment.project(np.concatenate([[0], ends]))
                    placed = np.column_stack([np.append(bounds[:-1], alignment.source_end), np.append(bounds[1:], alignment.source_end)])
                yield " ".join([*ids, str(self.end)]), text, sum(counts) + 1, placed


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that is part of no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                except UnicodeDecodeError:
                    continue
                break
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)
