"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased (A-Z), without the marks around and within them.  Features are the distinct unigrams, bigrams and
skip-grams (one word left out), and, as insults are inflected, the first 3 to 7 bytes of longer words as stems,
all hashed to 28 bits.  FTRL keeps an accumulator per coordinate, which sets that
coordinate's own learning rate, and L1 leaves most weights at exactly zero: what is broadcast are the others,
as sorted indices and values, a few kilobytes, bounded by the features of the bounded sample.

Scoring is one pass over the texts without a shuffle.

Defined results: a null text counts as empty; an empty text has the score of the bias; a null id belongs to the
rows that are not held out; rows may repeat; labels that contradict one another count as toxic; without labelled rows of both kinds
all scores are the bias's; an empty table gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import lean, Remembered
from .training import MAX_LABELLED, labelled_sample, remainder

BITS, MARKS = 28, b".,;:!?\"'()[]{}<>*#$%&|_~`"
STEMS = (3, 4, 5, 6, 7)
ALPHA, BETA, L1, L2, EPOCHS, MIN_DOCS = 2.0, 1.0, 4.0, 0.01, 6, 3
THRESHOLD = 0.7
#: Bytes of a worker's memory of words, and as many of their beginnings, unless told otherwise; more of them save time.
REMEMBERED = 16 << 20


def hashing(remembered: int = REMEMBERED) -> tuple[Remembered, Remembered]:
    """Word to its 64-bit hash, and to the hashes of its beginnings; each remembered within ``remembered`` bytes."""
    return Remembered(xxhash.xxh64_intdigest, remembered), Remembered(lambda word: tuple(xxhash.xxh64_intdigest(word[:n], seed=n) for n in STEMS if len(word) > n), remembered)


def features(text: str, hashes: Remembered, stems: Remembered) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().translate(None, MARKS).split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(0xD6E8FEB86659FD93)
        stem = np.fromiter(set(chain.from_iterable(map(stems.__getitem__, set(words)))), np.uint64)
        both = np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), pair, skip, stem])
    return np.unique((both >> np.uint64(64 - BITS)).astype(np.uint32))


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices, weights and bias from (features, label) in the given order."""
    if len({y for _, y in rows}) < 2:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), (-3.0 if not rows or rows[0][1] == 0 else 3.0)
    parts = []  # by high bits, so that only a sixteenth is sorted at a time
    for k in range(16):
        v, df = np.unique(np.concatenate([x[slice(*np.searchsorted(x, (k << BITS - 4, (k + 1) << BITS - 4)))] for x, _ in rows]), return_counts=True)
        parts.append(v[df >= MIN_DOCS])
    vocabulary = np.concatenate(parts)
    places = []
    for k, (x, y) in enumerate(rows):
        rows[k] = None  # what isn't needed any more is let go of
        at = np.searchsorted(vocabulary, x)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == x)] if len(vocabulary) else at[:0]
        del x
        places.append((np.append(at, len(vocabulary)).astype(np.int32), y))  # the last coordinate is the bias
    z, n = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    l1 = np.full(len(z), L1)
    l1[-1] = 0
    order = np.random.default_rng(7)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in order.permutation(len(places)):
            at, y = places[k]
            zi, ni = z[at], n[at]
            w = weights(zi, ni, l1[at])
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = weights(z, n, l1)
    used = np.flatnonzero(w[:-1])
    return vocabulary[used], w[used].astype(np.float32), float(w[-1])


class Model:
    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index, weight, bias
        self.seen = np.zeros(1 << 20, bool)  # most features are told apart by their last bits already
        self.seen[index & 0xFFFFF] = True

    def score(self, x: np.ndarray) -> float:
        x = x[self.seen[x & 0xFFFFF]]
        at = np.searchsorted(self.index, x)
        hit = at < len(self.index)
        at, x = at[hit], x[hit]
        return 1 / (1 + np.exp(-np.clip(self.bias + float(self.weight[at[self.index[at] == x]].sum()), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (3, 1), limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """(indices, weights, bias), learnt from rows whose crc32(id) modulo held_out[0] is not held_out[1]."""
    sample = labelled_sample(docs, labels, label, remainder(id_col, held_out[0]) != held_out[1], limit, id_col, text_col)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, stems = hashing()
        for b in batches:
            x = [features(t, hashes, stems).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("label"), pa.array(x, pa.binary())], ["id", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(str(i), np.frombuffer(x.as_buffer(), np.uint32), y) for b in batches for i, y, x in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("x"), strict=True)]
        rows.sort(key=lambda r: (r[0], len(r[1])))
        rows = [r[1:] for r in rows]
        index, weight, bias = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([index.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["index", "weight", "bias"])

    rows = sample.mapInArrow(lean(featurise), "id string, label int, x binary").repartition(1).mapInArrow(lean(learn), "index binary, weight binary, bias double").collect()
    return (np.frombuffer(rows[0]["index"], np.uint32), np.frombuffer(rows[0]["weight"], np.float32), rows[0]["bias"]) if rows else fit([])


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """id and score, one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (hashes, stems) = Model(*shared.value), hashing(remembered)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(features(t or "", hashes, stems)) for t in b.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, score double")


def clean(docs: DataFrame, model: tuple, text_col: str = "text", threshold: float = THRESHOLD, remembered: int = REMEMBERED) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (hashes, stems) = Model(*shared.value), hashing(remembered)
        for b in batches:
            yield b.filter(pa.array([m.score(features(t or "", hashes, stems)) < threshold for t in b.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
