"""A linear-chain conditional random field over words, in numpy.

States are languages.  A word's potential is the sum of the weights of its affixes, letter
n-grams, lexicon memberships and, for lexicon words, identity; a transition matrix is learned
with them, by gradient steps on the log-likelihood of sequences that switch language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import regex

from .pretoken import class_of, is_plain

_plain_words, _words = re.compile(f"[{class_of('L')}]+"), regex.compile(r"\p{L}+")
#: Fitting: lexicon words per language, features kept, words per training sequence and per stretch of one language.
LEXICON, FEATURES, SEQUENCE, STRETCH = 400, 120_000, 120, 24
BLOCK = 32
#: A text of more characters is judged in parts of so many words.
LONG_CHARS, PART_WORDS = 1_000_000, 100_000


def word_parts(text: str, count: int) -> Iterator[list[str]]:
    """The words of words_of, `count` at a time."""
    found = (_plain_words if is_plain(text) else _words).finditer(text.lower())
    while part := [m[0] for m in islice(found, count)]:
        yield part


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters, lower-cased."""
    text = text or ""
    return (_plain_words if is_plain(text) else _words).findall(text.lower())


def features_of(word: str, lexicon: dict[str, tuple[str, ...]]) -> list[str]:
    """Names of a word's features: p prefix, s suffix, otherwise letter n-grams; L lexicon, w identity."""
    w = f"^{word}$"
    n = len(w)
    out = [w[i : i + 2] for i in range(n - 1)]
    out += [w[i : i + 3] for i in range(n - 2)]
    out += ["p" + w[1:k] for k in (2, 3, 4) if k < n]
    out += ["s" + w[-k - 1 : -1] for k in (1, 2, 3, 4) if k < n - 1]
    if word in lexicon:
        out += ["L" + x for x in lexicon[word]]
        out.append("w" + word)
    return out


class Crf:
    """Languages, feature weights (features x languages) and log transitions (from x to)."""

    def __init__(self, langs: list[str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray, lexicon: dict[str, tuple[str, ...]], cache: int = 200_000):
        self.langs, self.index, self.weights, self.trans, self.lexicon, self.limit = langs, index, weights, trans, lexicon, cache
        self.at: dict[str, int] = {}
        self.held = np.zeros((1024, len(langs)))
        self.known = np.zeros(1024)  # of each word's features, the share that fitting saw

    def __reduce__(self):
        return Crf, (self.langs, self.index, self.weights, self.trans, self.lexicon, self.limit)

    def rows(self, word: str) -> list[int]:
        get = self.index.get
        return [r for f in features_of(word, self.lexicon) if (r := get(f)) is not None]

    def learn(self, words: Iterable[str]) -> None:
        """Put the potentials of new words into the bounded cache."""
        words = set(words)
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.limit:
            self.at, new = {}, list(words)
        first, total = len(self.at), len(self.at) + len(new)
        if total > len(self.held):
            self.held = np.concatenate([self.held[:first], np.zeros((2 * total - first, len(self.langs)))])
            self.known = np.concatenate([self.known[:first], np.zeros(2 * total - first)])
        get, rows = self.index.get, []
        for place, w in enumerate(new, first):
            named = features_of(w, self.lexicon)
            rows.append([r for f in named if (r := get(f)) is not None])
            self.known[place] = len(rows[-1]) / len(named)
        self.held[first:total] = emissions(rows, self.weights)
        self.at.update(zip(new, range(first, total), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, int, float]]:
        """Per text: language, mean marginal of its words, number of words, share of words labelled otherwise."""
        return [x[:4] for x in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, int, float, float]]:
        """As predict, and the mean share of its words' features that fitting saw.

        A text of over LONG_CHARS is taken in parts, which gives the same and holds one part.
        """
        long = {i for i, t in enumerate(texts) if t and len(t) > LONG_CHARS and self.langs}
        if long:
            rest = iter(self.judge([t for i, t in enumerate(texts) if i not in long]))
            return [self.judge_long(t) if i in long else next(rest) for i, t in enumerate(texts)]
        words = [words_of(t) for t in texts]
        none = ("und", 0.0, 0, 0.0, 0.0)
        if not self.langs:
            return [("und", 0.0, len(ws), 0.0, 0.0) for ws in words]
        self.learn(w for ws in words for w in ws)
        at = self.at
        ids = np.fromiter((at[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        sizes = np.array([len(ws) for ws in words])
        some = np.flatnonzero(sizes)
        out = [none] * len(texts)
        if len(some):
            sums, votes = marginals(self.held[ids], self.trans, sizes[some])
            best = sums.argmax(axis=1)
            known = np.add.reduceat(self.known[ids], np.cumsum(np.r_[0, sizes[some][:-1]]))
            for i, b, s, v, f in zip(some.tolist(), best.tolist(), sums, votes, known.tolist(), strict=True):
                n = int(sizes[i])
                out[i] = (self.langs[b], min(1.0, float(s[b]) / n), n, 1.0 - float(v[b]) / n, f / n)
        return out

    def judge_long(self, text: str) -> tuple[str, float, int, float, float]:
        """judge of one text in two passes over its parts: how each carries belief on, then the marginals inside each."""

        def parts():
            for words in word_parts(text, PART_WORDS):
                self.learn(words)
                ids = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
                yield self.held[ids], float(self.known[ids].sum())

        states = len(self.langs)
        carried = [stretch(scores, self.trans) for scores, _ in parts()]
        if not carried:
            return "und", 0.0, 0, 0.0, 0.0
        behind = [np.ones(states)]
        for p in carried[:0:-1]:
            v = p @ behind[-1]
            behind.append(v / v.max())
        behind.reverse()
        ahead, sums, votes, n, known = np.full(states, 1.0 / states), np.zeros(states), np.zeros(states, np.int64), 0, 0.0
        for (scores, seen), p, after in zip(parts(), carried, behind, strict=True):
            s, v = marginals(scores, self.trans, np.array([len(scores)]), before=ahead, after=after)
            sums, votes, n, known = sums + s[0], votes + v[0], n + len(scores), known + seen
            ahead = ahead @ p
            ahead /= ahead.sum()
        best = int(sums.argmax())
        return self.langs[best], min(1.0, float(sums[best]) / n), n, 1.0 - float(votes[best]) / n, known / n

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, marginal probability) of every word of a text."""
        words = words_of(text)
        if not words or not self.langs:
            return [(w, "und", 0.0) for w in words]
        self.learn(words)
        p = marginals(self.held[[self.at[w] for w in words]], self.trans, np.array([len(words)]), full=True)
        return [(w, self.langs[k], float(q[k])) for w, k, q in zip(words, p.argmax(axis=1).tolist(), p, strict=True)]


def emissions(rows: list[list[int]], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), weights.shape[1]))
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((r for rs in rows for r in rs), np.int64, int(sizes.sum()))
    if len(flat):
        some = np.flatnonzero(sizes)
        starts = np.cumsum(np.r_[0, sizes[some][:-1]])
        out[some] = np.add.reduceat(weights[flat], starts, axis=0)
    return out


def stretch(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The product of a stretch's step matrices, scaled: what it makes of the belief it starts with."""
    states = scores.shape[1]
    t, e = np.exp(trans), np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    count = -(-len(e) // BLOCK)
    x = np.ones((count * BLOCK, states))
    x[: len(e)] = e
    x, live = x.reshape(count, BLOCK, states), (np.arange(count * BLOCK) < len(e)).reshape(count, BLOCK)
    p = np.broadcast_to(np.eye(states), (count, states, states))
    for k in range(BLOCK):
        step = (p.reshape(-1, states) @ t).reshape(p.shape) * x[:, k, None, :]
        p = np.where(live[:, k, None, None], step / step.max(axis=(1, 2), keepdims=True), p)
    out = p[0]
    for block in p[1:]:
        out = out @ block
        out = out / out.max()
    return out


def marginals(scores: np.ndarray, trans: np.ndarray, sizes: np.ndarray, full: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Forward-backward over sequences laid end to end (sizes >= 1), exact.

    Sequences are cut into blocks.  The products of each block's step matrices are taken for
    all blocks at once, then forward and backward vectors pass from block to block, then all
    blocks are run inside; so a very long text costs steps of its blocks, not of its words.
    Returns sums of marginals and counts of best labels per sequence, or with full all marginals.
    before and after are what the rest of the text says where a single sequence is part of one.
    """
    n, states = scores.shape
    t = np.exp(trans)
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    per = -(-sizes // BLOCK)
    total = int(per.sum())
    first_block = np.r_[0, np.cumsum(per)[:-1]]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    inner = np.arange(total) - np.repeat(first_block, per)
    begin = np.repeat(starts, per) + inner * BLOCK
    length = np.minimum(BLOCK, np.repeat(sizes, per) - inner * BLOCK)
    where = begin[:, None] + np.arange(BLOCK)
    live = np.arange(BLOCK) < length[:, None]
    x = e[np.minimum(where, n - 1)]  # blocks x steps x states
    product = np.broadcast_to(np.eye(states), (total, states, states)).copy()
    several = np.flatnonzero(np.repeat(per > 1, per))
    if len(several):
        p = product[several]
        for k in range(BLOCK):
            step = (p.reshape(-1, states) @ t).reshape(p.shape) * x[several, k, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            p = np.where(live[several, k, None, None], step, p)
        product[several] = p
    ahead = np.full((total, states), 1.0 / states)
    behind = np.ones((total, states))
    if before is not None:
        ahead[0], behind[-1] = before, after
    for j in range(1, int(per.max())):
        b = first_block[per > j] + j
        a = np.einsum("bi,bij->bj", ahead[b - 1], product[b - 1])
        ahead[b] = a / a.sum(axis=1, keepdims=True)
        b = first_block[per > j] + per[per > j] - 1 - j
        a = np.einsum("bij,bj->bi", product[b + 1], behind[b + 1])
        behind[b] = a / a.max(axis=1, keepdims=True)
    alpha = np.empty((BLOCK, total, states))
    a = ahead
    for k in range(BLOCK):
        step = (a @ t) * x[:, k]
        step /= step.sum(axis=1, keepdims=True)
        a = np.where(live[:, k, None], step, a)
        alpha[k] = a
    beta = behind
    for k in range(BLOCK - 1, -1, -1):
        m = alpha[k] * beta
        alpha[k] = m / m.sum(axis=1, keepdims=True)
        step = (x[:, k] * beta) @ t.T
        step /= step.max(axis=1, keepdims=True)
        beta = np.where(live[:, k, None], step, beta)
    p = alpha.transpose(1, 0, 2)
    if full:
        return p[live]
    sums = np.add.reduceat((p * live[:, :, None]).sum(axis=1), first_block, axis=0)
    best = p.argmax(axis=2)
    votes = np.stack([((best == s) & live).sum(axis=1) for s in range(states)], axis=1)
    return sums, np.add.reduceat(votes, first_block, axis=0)


def fit(samples: list[tuple[str, str]], epochs: int = 3, batch: int = 64, rate: float = 0.3, l2: float = 1e-6, seed: int = 7) -> Crf:
    """Fit on (language, whole text) samples.

    Training sequences are made of stretches of words of single samples, in shuffled order,
    so that neighbours differ in language as in code-switched text.  AdaGrad steps.
    """
    langs = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    texts = [(langs.index(lang), words_of(text)) for lang, text in samples]
    counts = [Counter() for _ in langs]
    for k, ws in texts:
        counts[k].update(ws)
    totals = [max(1, sum(c.values())) for c in counts]
    every = Counter()
    for c in counts:
        every.update(c)
    lexicon: dict[str, tuple[str, ...]] = {}
    for k, lang in enumerate(langs):
        # words that are frequent here and mostly here
        odds = {w: n for w, n in counts[k].items() if n >= 3 and n / totals[k] >= 2 * sum(c[w] / t for c, t in zip(counts, totals, strict=True)) / (len(langs) + 1)}
        for w in sorted(odds, key=lambda w: (-odds[w], w))[:LEXICON]:
            lexicon[w] = (*lexicon.get(w, ()), lang)
    vocabulary = sorted(every)
    seen = Counter()
    for w in vocabulary:  # features are named twice rather than held
        for f in features_of(w, lexicon):
            seen[f] += every[w]
    index = {f: i for i, f in enumerate(sorted(sorted(seen), key=lambda f: -seen[f])[:FEATURES])}
    weights, trans = np.zeros((len(index), len(langs))), np.zeros((len(langs), len(langs)))
    model = Crf(langs, index, weights, trans, lexicon)
    if len(langs) < 1 or not vocabulary:
        return model if vocabulary else Crf([], {}, np.zeros((0, 0)), np.zeros((0, 0)), {})
    place = {w: i for i, w in enumerate(vocabulary)}
    rows = [np.array(model.rows(w), np.int32) for w in vocabulary]
    row_sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    row_starts = np.r_[0, np.cumsum(row_sizes)[:-1]]
    flat = np.concatenate(rows)
    del rows, seen
    stretches = [(k, np.array([place[w] for w in ws[i : i + STRETCH]], np.int32)) for k, ws in texts for i in range(0, len(ws), STRETCH)]
    g_w, g_t = np.full(weights.shape, 1e-4), np.full(trans.shape, 1e-2)
    per = SEQUENCE // STRETCH
    for _ in range(epochs):
        order = rng.permutation(len(stretches))
        for at in range(0, len(order), per * batch):
            part = [stretches[i] for i in order[at : at + per * batch]]
            ids = np.concatenate([s for _, s in part])
            gold = np.concatenate([np.full(len(s), k) for k, s in part])
            sizes = np.array([sum(len(s) for _, s in part[i : i + per]) for i in range(0, len(part), per)])
            used, back = np.unique(ids, return_inverse=True)
            reps = np.repeat(np.arange(len(used)), row_sizes[used])
            pos = np.concatenate([np.arange(row_starts[u], row_starts[u] + row_sizes[u]) for u in used]) if len(used) else np.empty(0, np.int64)
            feats = flat[pos]
            scores = np.stack([np.bincount(reps, weights[feats, k], minlength=len(used)) for k in range(len(langs))], axis=1)[back]
            p, pairs = _expectations(scores, trans, sizes)
            err = p
            err[np.arange(len(gold)), gold] -= 1
            word_err = np.stack([np.bincount(back, err[:, k], minlength=len(used)) for k in range(len(langs))], axis=1)
            touched, to = np.unique(feats, return_inverse=True)
            grad = np.stack([np.bincount(to, word_err[reps, k], minlength=len(touched)) for k in range(len(langs))], axis=1) / len(sizes) + l2 * weights[touched]
            ends = np.cumsum(sizes)
            inside = np.ones(len(gold), bool)
            inside[np.r_[0, ends[:-1]]] = False
            i = np.flatnonzero(inside)
            np.subtract.at(pairs, (gold[i - 1], gold[i]), 1)
            g_w[touched] += grad**2
            weights[touched] -= rate * grad / np.sqrt(g_w[touched])
            pairs /= len(sizes)
            g_t += pairs**2
            trans -= rate * pairs / np.sqrt(g_t)
    return Crf(langs, index, weights.astype(np.float32), trans, lexicon)


def _expectations(scores: np.ndarray, trans: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and expected transitions summed over the sequences (the first step is not a transition)."""
    n, states = scores.shape
    t, longest = np.exp(trans), int(sizes.max())
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    live = np.arange(longest) < sizes[:, None]
    x = e[np.minimum(starts[:, None] + np.arange(longest), n - 1)]
    alpha = np.empty((longest, len(sizes), states))
    a = np.full((len(sizes), states), 1.0 / states)
    for k in range(longest):
        step = (a @ t) * x[:, k]
        step /= step.sum(axis=1, keepdims=True)
        a = alpha[k] = np.where(live[:, k, None], step, a)
    beta, pairs = np.ones((len(sizes), states)), np.zeros((states, states))
    out = np.empty((longest, len(sizes), states))
    for k in range(longest - 1, -1, -1):
        m = alpha[k] * beta
        out[k] = m / m.sum(axis=1, keepdims=True)
        right = x[:, k] * beta
        if k:
            joint = alpha[k - 1][:, :, None] * t * right[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[live[:, k]].sum(axis=0)
        step = right @ t.T
        step /= step.max(axis=1, keepdims=True)
        beta = np.where(live[:, k, None], step, beta)
    return out.transpose(1, 0, 2)[live], pairs
