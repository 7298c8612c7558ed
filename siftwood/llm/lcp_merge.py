"""Merging sorted runs of turn sequences that carry the length of the prefix each shares with the one before.

A key is a string of digests, WIDTH characters a turn; lengths and shared prefixes are counted
in turns.  A loser tree knows of every waiting key how much of it equals the key that went out
last, so two keys of different such lengths are ordered without being read, and keys of equal
lengths are read from there on alone.
"""

from __future__ import annotations

from collections.abc import Iterator

WIDTH = 32
#: (key, id, shared prefix with the key before, anything)
Entry = tuple[str, int, int, object]


def shared_prefix(a: str, b: str, start: int = 0) -> int:
    """Turns that two keys begin with alike, of which `start` are known to be."""
    least = min(len(a), len(b)) // WIDTH
    at, step = start, 1
    while at < least:
        # strides double while they agree, so long shared stretches are compared in few steps
        end = min(at + step, least)
        if a[at * WIDTH : end * WIDTH] == b[at * WIDTH : end * WIDTH]:
            at, step = end, step * 2
        elif step == 1:
            return at
        else:
            step = 1
    return at


def sorted_run(rows: list[tuple[str, int, object]]) -> list[Entry]:
    """Rows (key, id, value) in the order of key and id, each with the prefix it shares with the row before."""
    rows.sort(key=lambda r: r[:2])
    out, before = [], ""
    for key, i, value in rows:
        out.append((key, i, shared_prefix(before, key), value))
        before = key
    return out


class LoserTree:
    """Merges sorted runs into one stream of entries with their shared prefixes, reading no shared turn twice."""

    def __init__(self, runs: list[list[Entry]]):
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.rests = [iter(r) for r in runs] + [iter(()) for _ in range(self.size - len(runs))]
        #: per run: its waiting entry, whose shared prefix is that with the key it last lost to
        self.heads: list[Entry | None] = [self._first(r) for r in self.rests]
        self.losers = [0] * self.size
        self.compared = 0
        self.winner = self._build(1)

    @staticmethod
    def _first(rest: Iterator[Entry]) -> Entry | None:
        head = next(rest, None)
        return head and (head[0], head[1], 0, head[3])

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = self._play(a, b)
        self.losers[node] = lost
        return won

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser keeps the prefix it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[2] != y[2]:  # the one that shares more with the last key out comes first
            return (a, b) if x[2] > y[2] else (b, a)
        both = shared_prefix(x[0], y[0], x[2])
        self.compared += both - x[2] + 1
        at = both * WIDTH
        u, v = x[0][at : at + WIDTH], y[0][at : at + WIDTH]
        first = u < v if u != v else x[1] <= y[1]
        won, lost = (a, b) if first else (b, a)
        self.heads[lost] = (*self.heads[lost][:2], both, self.heads[lost][3])
        return won, lost

    def __iter__(self) -> Iterator[Entry]:
        while (out := self.heads[self.winner]) is not None:
            yield out
            run = self.winner
            self.heads[run] = next(self.rests[run], None)
            node = (run + self.size) // 2
            while node:
                won, lost = self._play(run, self.losers[node])
                self.losers[node], run = lost, won
                node //= 2
            self.winner = run
