"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in its features: shares of byte values, shares of the bytes that words start and
end with, and some ratios (repeated words and lines, word lengths, words in a line).  Pairs of a document with label
1 and one with label 0 are preferences; the model maximises their likelihood under Bradley-Terry, which is logistic
loss on differences of features.  The cut is a quantile: the score below which lies the share of label 0 among the
labelled rows.  Scores are then squashed so that the cut has the value ``THRESHOLD``.

Every labelled row that may be learnt from counts, and every pair of them: nothing is drawn.  What a document's pairs say of it follows
from how the scores of the other kind are spread, so the sum over all pairs takes two passes over the rows: one counts scores in bins (a score
is shared out between the two bins beside it, which changes a pair's likelihood by at most ``BIN`` squared / 16), the other weighs the features.
L-BFGS on the driver makes some twenty steps of them.  The quantile is found by counting in ever smaller bins.  A task sends back its
bins or 778 numbers, never rows; features of the labelled rows are stored once.

Features take one pass over the texts and scoring no shuffle; the model is some 800 numbers.

Defined results: a null text counts as empty and is scored like one; a null id belongs to the held-out rows; rows may
repeat; labels that contradict one another count as 1; without labelled rows of both kinds all scores are 0.5; an empty table
gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, stored
from .training import labelled, remainder

THRESHOLD = 0.3
#: Steps at most, the gradient's length that ends them, how many steps are remembered, and the weight of the squared weights.
STEPS, ENOUGH, MEMORY, DECAY = 40, 1e-5, 10, 1e-3
#: Width of the bins in which scores are counted, and the difference beyond which a pair is taken as settled (by e to the -40).
BIN, REACH = 1 / 32, 40
#: Bins of the quantile's search, and its rounds: each narrows the score down by so much.
NARROW, ROUNDS = 4096, 3
RATIOS = 10
WIDTH = 3 * 256 + RATIOS
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def features(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    if not data:
        return out
    b = np.frombuffer(data, np.uint8)
    gap = _SPACE[b]
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    ends = np.flatnonzero(~gap & np.append(gap[1:], True))
    n = max(1, len(starts))
    out[:256] = np.bincount(b, minlength=256) / len(b)
    out[256:512] = np.bincount(b[starts], minlength=256) / n
    out[512:768] = np.bincount(b[ends], minlength=256) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    pairs = list(zip(words, words[1:]))
    out[768:] = (
        np.log1p(n), (ends - starts + 1).mean() if len(starts) else 0, len(set(words)) / n, sum(a == c for a, c in pairs) / n, len(set(pairs)) / max(1, len(pairs)),
        len(set(lines)) / m, np.log1p(n / m), sum(w.isupper() for w in words) / n, sum(w.isalpha() for w in words) / n, np.log1p(max(map(len, words), default=0)),
    )
    return out


def by_task(rows: DataFrame, work: Callable[[Iterator], tuple]) -> list[list[np.ndarray]]:
    """The arrays that ``work`` makes of each task's (labels, features), which it gets batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work((b.column("label").to_numpy(), np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([[np.asarray(a, np.float64).tobytes() for a in made]], pa.list_(pa.binary()))], ["made"])

    return [[np.frombuffer(a, np.float64) for a in r["made"]] for r in rows.mapInArrow(lean(run), "made array<binary>").collect()]


def moments(read: Iterator) -> tuple:
    """Rows of label 0 and 1, sums of the features and of their squares."""
    n, sums, squares = np.zeros(2), np.zeros(WIDTH), np.zeros(WIDTH)
    for y, x in read:
        x = x.astype(np.float64)
        n, sums, squares = n + np.bincount(y, minlength=2), sums + x.sum(0), squares + (x * x).sum(0)
    return n, sums, squares


def bins(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive bins and how much of label 0 and 1 they hold, from (bins, label 0, label 1) in any order."""
    if not parts:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    k, *held = (np.concatenate(x) for x in zip(*parts))
    first = k.min() if len(k) else 0
    held = [np.bincount((k - first).astype(np.int64), h) for h in held]
    return first + np.arange(len(held[0])), *held


def counted(scores: Iterator) -> tuple:
    """Bins of the scores, of (labels, scores): those that hold something."""
    parts = []
    for y, s in scores:
        k = np.floor(s / BIN)
        upper = s / BIN - k
        parts.append(bins([(k, (y == 0) * (1 - upper), (y == 1) * (1 - upper)), (k + 1, (y == 0) * upper, (y == 1) * upper)]))
    k, bad, good = bins(parts)
    some = (bad > 0) | (good > 0)
    return k[some], bad[some], good[some]


def near(counts: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """At each bin, the sum over the others of their counts times the kernel of the distance."""
    r = round(REACH / BIN)
    return np.convolve(counts, kernel(np.arange(r, -r - 1, -1) * BIN))[r : r + len(counts)]


def pairs(k: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Over all pairs, of the bins: the mean loss; the bins' scores, and there the mean pull on a document of label 1 and on one of label 0."""
    t, all_ = k * BIN, bad.sum() * good.sum()

    def lost(counts: np.ndarray) -> np.ndarray:  # probabilities that documents of these counts are ranked above one of this score
        return counts.sum() - np.cumsum(counts) + counts / 2 + near(counts, lambda d: np.sign(d) * -1 / (1 + np.exp(np.abs(d))))

    above, moment = bad.sum() - np.cumsum(bad), (bad * t).sum() - np.cumsum(bad * t)
    loss = good @ (moment - above * t + near(bad, lambda d: np.log1p(np.exp(-np.abs(d)))))
    return loss / all_, t, lost(bad) / all_, (good.sum() - lost(good)) / all_


def quantile(scored: Callable, n: np.ndarray, low: float, high: float) -> float:
    """Of all scores, which lie from ``low`` to ``high``, the quantile at the share of label 0, between the two scores beside it."""
    ranks = n[0] - 1, n[0]
    ends = [(low, high)] * 2
    for _ in range(ROUNDS):

        def count(scores: Iterator, ends=tuple(ends)) -> tuple:
            out = np.zeros((2, NARROW + 1))
            for _, s in scores:
                for (a, b), o in zip(ends, out):
                    o += np.bincount(np.clip(np.floor((s - a) / (b - a) * NARROW) + 1, 0, NARROW + 1).astype(np.int64), minlength=NARROW + 2)[:-1]
            return tuple(out)

        for i, counts in enumerate(np.sum(scored(count), 0)):  # the first is what lies below
            at, (a, b) = min(int(np.searchsorted(np.cumsum(counts), ranks[i], "right")), NARROW), ends[i]
            if at and b > a:
                ends[i] = a + (at - 1) * (b - a) / NARROW, a + at * (b - a) / NARROW
    return ends[0][0] + (1 - n[0] / n.sum()) * (ends[1][0] - ends[0][0])


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Mean and spread of the features, weights, cut and scale, of the stored ``rows`` (label, x), all of them and all their pairs."""
    made = by_task(rows, moments)
    n, sums, squares = (sum(x) for x in zip(*made)) if made else (np.zeros(2), np.zeros(WIDTH), np.zeros(WIDTH))
    w, total = np.zeros(WIDTH), max(1, n.sum())
    mean = sums / total
    spread = np.sqrt(np.maximum(0, squares / total - mean * mean)) + 1e-4
    if not n.all():
        return mean, spread, w, float(np.log(0.3 / 0.7)), 1.0

    def scored(w: np.ndarray, work: Callable) -> list[list[np.ndarray]]:
        return by_task(rows, lambda read: work((y, np.clip((x - mean) / spread, -8, 8) @ w) for y, x in read))

    def loss(w: np.ndarray) -> tuple:
        value, *pulls = pairs(*bins(scored(w, counted)))
        return value + DECAY / 2 * w @ w, pulls

    def gradient(w: np.ndarray, pulls: list) -> np.ndarray:
        t, up, down = pulls

        def weigh(read: Iterator) -> tuple:
            g = np.zeros(WIDTH)
            for y, x in read:
                z = np.clip((x - mean) / spread, -8, 8)
                g += np.where(y == 1, -np.interp(z @ w, t, up), np.interp(z @ w, t, down)) @ z
            return (g,)

        return sum(g for (g,) in by_task(rows, weigh)) + DECAY * w

    value, pulls = loss(w)
    g, past = gradient(w, pulls), []
    for _ in range(STEPS):
        if np.sqrt(g @ g) <= ENOUGH:
            break
        d, shares = -g, []
        for s, c in reversed(past):
            shares.append(s @ d / (s @ c))
            d = d - shares[-1] * c
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.sqrt(g @ g))
        for (s, c), share in zip(past, reversed(shares)):
            d = d + (share - c @ d / (s @ c)) * s
        step = 1.0
        new, new_pulls = loss(w + d)
        while new > value + 1e-4 * step * (g @ d) and step > 1e-3:
            step /= 2
            new, new_pulls = loss(w + step * d)
        if new >= value:  # what is left to gain is less than the bins tell apart
            break
        turned = gradient(w + step * d, new_pulls)
        if step * d @ (turned - g) > 1e-12:
            past = [*past, (step * d, turned - g)][-MEMORY:]
        w, g, value, pulls = w + step * d, turned, new, new_pulls
    t = pulls[0]
    cut = quantile(lambda work: scored(w, work), n, t[0], t[-1] + BIN)

    def spread_of(scores: Iterator) -> tuple:
        return (sum((np.array([s.sum(), (s * s).sum()]) for _, s in scores), np.zeros(2)),)

    one, two = sum(x for (x,) in scored(w, spread_of)) / total
    return mean, spread, w, float(cut), max(1e-6, float(np.sqrt(max(0, two - one * one))) / 2)


class Model:
    def __init__(self, mean, spread, w, cut: float, scale: float):
        self.mean, self.spread, self.w, self.cut, self.scale = mean, spread, w, cut, scale

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.spread, -8, 8) @ self.w
        return 1 / (1 + np.exp(-np.clip((s - self.cut) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """The model, learnt from all labelled rows whose crc32(id) modulo held_out[0] is not held_out[1]."""
    rows = labelled(docs, labels, label, remainder(id_col, held_out[0]) != held_out[1], id_col, text_col).filter("label IN (0, 1)")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([features(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())], ["label", "x"])

    return fit(stored(rows.select("label", "text").mapInArrow(lean(featurise), "label int, x binary"), "features"))


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score, one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                x = np.stack([features(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(x), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, score double")
