"""A small causal self-attention model over subword ids, in numpy.

Texts are lower-cased words; each word, with a space before it, is cut into byte-BPE
ids, and an end follows the last word. A document is the sequence of its words' first
ids. Frequent first ids are units of their own, the rest share units. One attention
layer reads the units and predicts the class of the next first id (a cluster of first
ids that keep similar company). Given the class, the id and the rest of its word have
the word's share of the class in the training corpus, so a word's probability is
exact and probabilities sum to one.

A window is two blocks of ``SPAN`` places. Only the second block is scored, with keys
from both, so that every place is scored once with at least ``SPAN`` places of context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SPAN = 16
WIDTH = 16
HIDDEN = 32
UNITS = 1024
#: Classes: so many clusters of first ids, one of the other first ids and the end's own.
CLUSTERS = 46
CLASSES = CLUSTERS + 2
#: First ids that are clustered: the most frequent, if met so often; and the buckets of neighbours that tell their company.
CLUSTERED, MET, BUCKETS = 8192, 5, 64
#: Windows scored at a time, so that tables stay in the cache.
CHUNK = 256
#: Windows of a training step.
BATCH = 256
#: Columns of a unit's table: query, key, value, hidden.
_Q, _K, _V, _X = (slice(a, b) for a, b in ((0, WIDTH), (WIDTH, 2 * WIDTH), (2 * WIDTH, 3 * WIDTH), (3 * WIDTH, 3 * WIDTH + HIDDEN)))
FAR = np.float32(-1e9)
#: Up to here exponentials neither overflow nor vanish in single precision.
SAFE = 80.0

Weights = dict[str, np.ndarray]


@dataclass
class Vocabulary:
    """From a first id to its unit and its class."""

    unit: np.ndarray
    kind: np.ndarray
    prior: np.ndarray = field(repr=False)

    @property
    def pad(self) -> int:
        return UNITS

    @classmethod
    def of(cls, counts: np.ndarray, company: np.ndarray, members: np.ndarray) -> Vocabulary:
        """``counts`` of every first id in the training documents, the end last; ``company``: a row of counts for each of ``members``."""
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        kind = np.full(len(counts), CLUSTERS)
        if len(members):
            kind[members] = clusters(company, counts[members], CLUSTERS)
        kind[-1] = CLASSES - 1
        free = UNITS - CLASSES
        unit = np.where(rank < free, rank, free + kind)
        total = np.bincount(kind, counts, CLASSES) + 0.5
        return cls(unit.astype(np.int32), kind.astype(np.int32), np.log(total / total.sum()).astype(np.float32))


def bucket(ids: np.ndarray) -> np.ndarray:
    """A first id's bucket as a neighbour."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)


def clusters(rows: np.ndarray, weight: np.ndarray, k: int, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """Weighted k-means of the square roots of each row's shares."""
    x = np.sqrt((rows + 0.01) / (rows + 0.01).sum(1, keepdims=True))
    rng = np.random.default_rng(seed)
    share = weight / weight.sum()
    centres = x[[rng.choice(len(x), p=share)]]
    while len(centres) < min(k, len(x)):  # far points first
        far = np.maximum(0, 2 - 2 * x @ centres.T).min(1) * share
        if far.sum() <= 1e-12:
            break
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=far / far.sum())]]])
    for _ in range(rounds):
        near = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in range(len(centres)):
            own = near == c
            if own.any():
                centres[c] = np.average(x[own], axis=0, weights=weight[own])
    return near


def start(vocabulary: Vocabulary, seed: int = 7) -> Weights:
    """Weights that predict each class by its share and know nothing else yet."""
    rng = np.random.default_rng(seed)
    normal = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
    d, h = WIDTH, HIDDEN
    return {
        "E": normal(UNITS + 1, d, by=0.5), "T": normal(d, 3 * d + h, by=d**-0.5), "bias": np.zeros((SPAN, 2 * SPAN), np.float32), "B": normal(d, h, by=d**-0.5), "c": np.zeros(h, np.float32),
        "O": normal(h, CLASSES, by=0.01 * h**-0.5), "o": vocabulary.prior.copy(),
    }


_later = np.where(np.arange(2 * SPAN)[None, :] > np.arange(SPAN)[:, None] + SPAN, FAR, np.float32(0))


@dataclass
class Blocks:
    """Sequences cut into blocks: units that are read (pad: nothing there), classes to predict (-1: none), and whether a block has none before it."""

    units: np.ndarray
    kinds: np.ndarray
    opening: np.ndarray
    #: Where the place of each id lies.
    place: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, ids: np.ndarray, ends: np.ndarray, begins: np.ndarray, skip: np.ndarray, vocabulary: Vocabulary) -> Blocks:
        """ids: of all sequences, one after the other; ends: where each ends; begins: the id before each; skip: how many places at its start are only read."""
        lengths = np.diff(ends, prepend=0)
        blocks = -(-lengths // SPAN)
        first = np.cumsum(blocks) - blocks
        place = np.arange(len(ids)) + np.repeat(first * SPAN - (ends - lengths), lengths)
        total = int(blocks.sum())
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        some = lengths > 0
        starts = (ends - lengths)[some]
        before[starts] = begins[some]
        units = np.full(total * SPAN, vocabulary.pad, np.int32)
        units[place] = vocabulary.unit[before]
        kinds = np.full(total * SPAN, -1, np.int32)
        kinds[place] = np.where(np.arange(len(ids)) - np.repeat(ends - lengths, lengths) < np.repeat(skip, lengths), -1, vocabulary.kind[ids])
        opening = np.zeros(total, bool)
        opening[first[some]] = True
        return cls(units.reshape(total, SPAN), kinds.reshape(total, SPAN), opening, place)

    def batches(self, rng: np.random.Generator, size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(units of windows, classes) of blocks with something to predict, shuffled."""
        asked = rng.permutation(np.flatnonzero((self.kinds >= 0).any(1)))
        for a in range(0, len(asked), size):
            own = asked[a : a + size]
            back = np.where(self.opening[own, None], UNITS, self.units[own - 1])
            yield np.concatenate([back, self.units[own]], 1), self.kinds[own]


def _scatter(units: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``rows`` by unit."""
    columns = np.ascontiguousarray(rows.reshape(-1, rows.shape[-1]).T)
    flat = units.ravel()
    return np.array([np.bincount(flat, c, UNITS + 1) for c in columns], np.float32).T


def gradients(w: Weights, units: np.ndarray, kinds: np.ndarray) -> tuple[float, Weights]:
    """Mean loss in nats over the second blocks, and its gradients. units (n, 2 SPAN), kinds (n, SPAN), -1 for none."""
    table = w["E"] @ w["T"]
    own = units[:, SPAN:]
    n, scale = len(units), WIDTH**-0.5
    mine = table[:, [*range(WIDTH), *range(_X.start, _X.stop)]].take(own, 0)
    kv = table[:, _K.start : _V.stop].take(units, 0)
    q, k, v = mine[..., :WIDTH], kv[..., :WIDTH], kv[..., WIDTH:]
    s = q @ k.transpose(0, 2, 1)
    s *= np.asarray(scale, s.dtype)
    s += w["bias"] + _later
    s += np.where(units[:, None, :] == UNITS, FAR, np.float32(0))
    s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(-1, keepdims=True)
    c = (s @ v).reshape(-1, WIDTH)
    h = c @ w["B"]
    h += mine[..., WIDTH:].reshape(-1, HIDDEN)
    h += w["c"]
    np.maximum(h, 0, out=h)
    p = h @ w["O"]
    p += w["o"]
    p -= p.max(-1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(-1, keepdims=True)
    t = kinds.ravel()
    real = np.flatnonzero(t >= 0)
    m = max(1, len(real))
    loss = -float(np.log(p[real, t[real]] + 1e-30).sum()) / m
    p[real, t[real]] -= 1
    if len(real) < len(t):
        p[t < 0] = 0
    p *= np.asarray(1 / m, p.dtype)
    out = {"O": h.T @ p, "o": p.sum(0)}
    g = p @ w["O"].T
    g *= h > 0
    out |= {"B": c.T @ g, "c": g.sum(0)}
    gc = (g @ w["B"].T).reshape(n, SPAN, WIDTH)
    ga = gc @ v.transpose(0, 2, 1)
    ga -= (ga * s).sum(-1, keepdims=True)
    ga *= s
    out["bias"] = ga.sum(0)
    gv = s.transpose(0, 2, 1) @ gc
    ga *= np.asarray(scale, ga.dtype)
    gq, gk = ga @ k, ga.transpose(0, 2, 1) @ q
    of_own, of_all = _scatter(own, np.concatenate([gq.reshape(-1, WIDTH), g], 1)), _scatter(units, np.concatenate([gk, gv], 2))
    gt = np.concatenate([of_own[:, :WIDTH], of_all, of_own[:, WIDTH:]], 1).astype(w["E"].dtype)
    return loss, out | {"T": w["E"].T @ gt, "E": gt @ w["T"].T}


def train(w: Weights, batches: Iterator[tuple[np.ndarray, np.ndarray]], *, steps: int, rate: float = 0.01) -> tuple[Weights, float]:
    """Adam from ``w``, one step for each of ``batches`` (units, kinds), with a rate that falls over ``steps``, their expected number; returns new weights and the mean loss."""
    w = {k: x.copy() for k, x in w.items()}
    one, two = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    total, t = 0.0, 0
    for t, (units, kinds) in enumerate(batches, 1):
        loss, g = gradients(w, units, kinds)
        total += loss
        for k in w:
            one[k] += 0.1 * (g[k] - one[k])
            two[k] += 0.01 * (g[k] ** 2 - two[k])
            w[k] -= np.float32(rate * (1 - 0.9 * min(1, t / steps))) * (one[k] / np.float32(1 - 0.9**t)) / (np.sqrt(two[k] / np.float32(1 - 0.99**t)) + np.float32(1e-7))
    return w, total / max(1, t)


class Scorer:
    """Log probabilities of classes; what depends on one unit alone is tabulated."""

    def __init__(self, w: Weights, vocabulary: Vocabulary):
        self.w, self.vocabulary = w, vocabulary
        table = w["E"] @ w["T"]
        self.q = np.ascontiguousarray(table[:, _Q]) * np.float32(WIDTH**-0.5)
        self.kv = np.concatenate([table[:, _K], table[:, _V], np.ones((UNITS + 1, 1), np.float32)], 1)  # the ones add up the attention's weights
        self.x = table[:, _X] + w["c"]
        self.bias = w["bias"] + _later
        reach = np.linalg.norm(self.q, axis=1).max() * np.linalg.norm(self.kv[:, :WIDTH], axis=1).max() + np.abs(w["bias"]).max()
        self.steep = bool(reach > SAFE)  # attention scores may overflow, or vanish all together

    def score(self, ids: np.ndarray, ends: np.ndarray, begin: int) -> np.ndarray:
        """Natural log probability of the classes of each document. ids: of all documents, one after the other; ends: where each ends; begin: the id before a first one."""
        n = len(ends)
        b = Blocks.of(ids, ends, np.full(n, begin), np.zeros(n, np.int64), self.vocabulary)
        total = len(b.units)
        got = np.empty(total * SPAN, np.float32)
        ones = np.ones(CLASSES, np.float32)
        padded = np.concatenate([np.full((1, SPAN), UNITS, np.int32), b.units])
        for a in range(0, total, CHUNK):
            z = min(total, a + CHUNK)
            kv = self.kv.take(padded[a : z + 1].ravel(), 0)
            step = kv.strides
            kv = np.lib.stride_tricks.as_strided(kv, (z - a, 2 * SPAN, kv.shape[1]), (SPAN * step[0], *step))
            own = b.units[a:z]
            s = self.q.take(own, 0) @ kv[..., :WIDTH].transpose(0, 2, 1)
            s += self.bias
            s[b.opening[a:z], :, :SPAN] = FAR
            if self.steep:
                s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            read = (s @ kv[..., WIDTH:]).reshape(-1, WIDTH + 1)
            h = (read[:, :WIDTH] / read[:, WIDTH:]) @ self.w["B"]
            h += self.x.take(own.ravel(), 0)
            np.maximum(h, 0, out=h)
            y = h @ self.w["O"]
            y += self.w["o"]
            if max(y.max(initial=0), -y.min(initial=0)) > SAFE:
                y -= y.max(-1, keepdims=True)
            kinds = b.kinds[a:z].ravel()
            hit = y[np.arange(len(y)), kinds]
            np.exp(y, out=y)
            hit -= np.log(y @ ones)
            got[a * SPAN : z * SPAN] = hit
        sums = np.concatenate([[0.0], np.cumsum(got[b.place], dtype=np.float64)])
        return sums[ends] - sums[ends - np.diff(ends, prepend=0)]
