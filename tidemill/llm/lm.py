"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: the words' 64-bit hashes in order, as an Elias-Fano sequence; a word's id is its place.  In levels 2 and 3 a
node is a context, of one word or two, and a word.  The contexts' first children are a monotone pointer sequence; children's ids are made
monotone by adding their context's base, its place times the size of the vocabulary, so that one Elias-Fano sequence holds all of them, and a
child is found by a successor search for its id relative to its context.  Smoothing is interpolated absolute discounting: a node holds its discounted
probability, a context its back-off weight, both quantised to 16 bits, and a token's probability is the sum of the first and of the second
times that of the level below.  Levels are cut into shards, files in the shared folder that workers memory-map.

Counts cover all training documents and whole texts, and every n-gram is kept.  Texts are turned into ids once; counting and scoring read
these.  What is counted are trigrams alone, in each text one for each token (the last ends in padding), as bigrams' counts are sums of
theirs.  Tasks sort and sum blocks of some million tokens and send each shard its part as one binary value.  Shards are ranges of trigrams,
cut by a sample so that they get equally many tokens: a frequent word, or pair, is spread over as many shards as it takes.  A
context that lies in several has its totals put together from their first and last contexts, a few numbers a shard, on the driver.
Scoring is one pass without a shuffle.

Defined results: a null text is empty, and an empty text is the end token alone; a null id belongs to the rows that are not held out; rows
may repeat and count each time; without training documents every probability is 1; a vocabulary beyond 2^31 words is an error; an empty table
gives an empty result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import filesystem, lean, new_path, publish, stored
from .elias_fano import U64, EliasFano, from_bytes, from_file, to_bytes

DISCOUNT = 0.75
#: Words of a vocabulary shard and tokens of an n-gram shard, about; tokens that are counted together, and that are scored together (some 300
#: bytes each); trigrams that the sample has for each shard; bytes that a worker remembers words in.
SHARD, SHARD_TOKENS, BLOCK, SCORED, SAMPLE, REMEMBERED = 2_000_000, 2_500_000, 1_500_000, 500_000, 500, 48 << 20
END = "\n"
STEP = 16 / 65535
UNKNOWN = 0xFFFFFFFF


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


def weights(types: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Back-off codes of contexts: 0 for those that have no children."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(types > 0, np.maximum(quantised(np.log10(DISCOUNT * types / whole)), 1), 0).astype(np.uint16)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """Stored, (h, c): hash and count of each token.  Words are counted as words; hashing comes after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "c"])
            counts.clear()
            return b

        for b in batches:
            texts = b.column(0).to_pylist()
            counts[END.encode()] += len(texts)
            for text in texts:
                if text:
                    counts.update(words_of(text))
                if len(counts) > 300_000:
                    yield out()
        if counts:
            yield out()

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return stored(each.select(F.xxhash64("word").alias("h"), "c"), "vocabulary")


def swept(spark: SparkSession, done: DataFrame | None = None) -> None:
    """Lets go of what is needed no more: a stored table, and the shuffle files of finished queries, which stay until the driver collects its garbage."""
    if done is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(done.inputFiles()[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


class Level:
    """The shards of a level, opened as they are needed."""

    def __init__(self, shards: list[tuple[int, int, str]]):
        """(first key, entries, path), by first key."""
        self.first = np.array([s[0] for s in shards], np.int64)
        self.base = np.concatenate([[0], np.cumsum([s[1] for s in shards], dtype=np.int64)])
        self.paths, self.open = [s[2] for s in shards], {}

    def shard(self, k: int) -> tuple:
        if k not in self.open:
            parts = from_file(self.paths[k])
            self.open[k] = (parts, {x: EliasFano(parts, x) for x in ("keys", "pointers", "words") if f"{x}.size" in parts})
        return self.open[k]

    def split(self, number: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places that it serves)."""
        if len(self.paths) == 1:
            yield 0, np.arange(len(number))
            return
        order = np.argsort(number, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            if len(at):
                yield int(number[at[0]]), at

    def holding(self, node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return self.split(np.searchsorted(self.base, node, "right") - 1)

    def values(self, field: str, node: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), np.int64)
        for k, at in self.holding(node):
            out[at] = self.shard(k)[0][field][node[at] - self.base[k]]
        return out


class Vocabulary(Level):
    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes (signed), -1 for those that are not there."""
        out = np.full(len(h), -1, np.int64)
        if not self.paths or not len(h):
            return out
        number = np.searchsorted(self.first, h, "right") - 1
        for k, at in self.split(np.maximum(number, 0)):
            keys = self.shard(k)[1]["keys"]
            x = h[at].astype(np.int64).view(U64) - np.int64(self.first[k]).view(U64)  # wraps like the subtraction it is
            place = keys.find(x)
            found = (h[at] >= self.first[k]) & (place >= 0)
            out[at[found]] = place[found] + self.base[k]
        return out


class Bigrams(Level):
    """Level 2: shards by their first bigram, numbered as ``pair`` does."""

    def __init__(self, shards: list[tuple[int, int, str]], size: int):
        super().__init__(shards)
        self.size, self.bits = size, size.bit_length()
        self.first = np.array([s[0] for s in shards], U64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(U64) << U64(self.bits) | b.astype(U64)

    def find(self, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted pairs: nodes, -1 for those that are not there, their probabilities' codes, and the back-off codes of their contexts."""
        node, code, backoff = np.full(len(hi), -1, np.int64), np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        for k, at in self.split(np.searchsorted(self.first, hi, "right") - 1):
            if k < 0:
                continue
            parts, ef = self.shard(k)
            j = (hi[at] >> U64(self.bits)) - (self.first[k] >> U64(self.bits))
            inside = j < len(parts["backoff"])
            at, j = at[inside], j[inside]
            backoff[at] = parts["backoff"][j.astype(np.int64)]
            place = ef["words"].find(j * U64(self.size + 1) + (hi[at] & U64((1 << self.bits) - 1)))
            there = place >= 0
            at, place = at[there], place[there]
            node[at], code[at] = place + self.base[k], parts["prob"][place]
        return node, code, backoff

    def children(self, a: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of a context and their nodes, by the pointers to its first child and to the next context's, in all shards that it lies in."""
        words, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        lowest, beyond = np.searchsorted(self.first, U64(a << self.bits), "right"), np.searchsorted(self.first, U64(a + 1 << self.bits), "left")
        for k in range(max(0, int(lowest) - 1), int(beyond)):
            parts, ef = self.shard(k)
            j = a - int(self.first[k] >> U64(self.bits))
            if 0 <= j < len(parts["backoff"]):
                b, e = (int(x) for x in ef["pointers"].get(np.array([j, j + 1])))
                words.append((ef["words"].get(np.arange(b, e)) - U64(j) * U64(self.size + 1)).astype(np.int64))
                nodes.append(np.arange(b, e) + self.base[k])
        return np.concatenate(words), np.concatenate(nodes)


class Trigrams(Level):
    """Level 3: shards by their first trigram (pair, word); the contexts of each begin with the node of its first pair."""

    def __init__(self, shards: list[tuple[int, int, int, str]], size: int):
        super().__init__([(0, 0, s[3]) for s in shards])
        self.size = size
        self.hi, self.c, self.context = np.array([s[0] for s in shards], U64), np.array([s[1] for s in shards], np.int64), np.array([s[2] for s in shards], np.int64)

    def find(self, hi: np.ndarray, node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts (sorted pairs and their nodes) and words: codes of their probabilities, -1 for those that are not there, and the contexts' back-off codes."""
        code, backoff = np.full(len(hi), -1, np.int64), np.zeros(len(hi), np.int64)
        for k, at in self.split(range_of(hi, c, self.hi, self.c) - 1):
            if k < 0:
                continue
            parts, ef = self.shard(k)
            j = node[at] - self.context[k]
            inside = (j >= 0) & (j < len(parts["backoff"]))
            at, j = at[inside], j[inside]
            backoff[at] = parts["backoff"][j]
            known = (c[at] < self.size) & (backoff[at] > 0)
            at, j = at[known], j[known]
            place = ef["words"].find(j.astype(U64) * U64(self.size + 1) + c[at].astype(U64))
            there = place >= 0
            code[at[there]] = parts["prob"][place[there]]
        return code, backoff


def range_of(hi: np.ndarray, c: np.ndarray, first_hi: np.ndarray, first_c: np.ndarray) -> np.ndarray:
    """The number of bounds (first_hi, first_c) that are not after (hi, c)."""
    out = np.searchsorted(first_hi, hi, "right")
    for b in np.unique(first_hi):  # pairs that bounds cut
        k, e = np.searchsorted(first_hi, [b, b], "left")[0], np.searchsorted(first_hi, b, "right")
        at = np.flatnonzero(hi == b)
        if len(at):
            out[at] = k + np.searchsorted(first_c[k:e], c[at], "right")
    return out


class Model:
    """What workers hold of a model: opened levels and remembered words."""

    def __init__(self, levels: list[list[tuple]], total: int, size: int):
        self.levels = [Vocabulary(levels[0]), *(kind(x, size) for kind, x in zip((Bigrams, Trigrams), levels[1:], strict=False))]
        self.total, self.size, self.known, self.bytes = total, size, {}, 0
        self.end = int(self.word_ids([END.encode()])[0])

    @property
    def denominator(self) -> float:
        return self.total + 0.5 * (self.size + 1)

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if new and self.bytes > REMEMBERED:
            self.known, self.bytes = {}, 0
            new = list(set(words))
        if new:
            h = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in new), U64, len(new)).view(np.int64)
            self.known.update(zip(new, self.levels[0].ids(h).tolist(), strict=True))
            self.bytes += sum(map(len, new)) + 170 * len(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Of ids, some of them unknown."""
        c = np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids < self.size)
        each, at = np.unique(ids[known], return_inverse=True)
        c[known] = self.levels[0].values("counts", each.astype(np.int64))[at]
        return c

    def score(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text, of which ``ids`` has the tokens, the end tokens included."""
        counts = self.counts(ids)
        one = (counts + 0.5) / self.denominator
        p = one.copy()
        before = np.append(self.end, ids[:-1]).astype(np.int64)
        before[starts] = self.end
        known = np.flatnonzero((ids < self.size) & (before >= 0) & (before < self.size))
        if len(self.levels) > 1 and len(known):
            two, three = self.levels[1:]
            hi = two.pair(before[known], ids[known])
            order = np.argsort(hi)
            known, hi = known[order], hi[order]
            new = np.append(True, hi[1:] != hi[:-1])
            each = np.cumsum(new) - 1
            node, code, backoff = two.find(hi[new])
            found, node, backoff = (node >= 0)[each], node[each], backoff[each]
            p[known] = np.where(backoff > 0, 10.0 ** (-STEP * backoff), 1.0) * one[known] + np.where(found, (10.0 ** (-STEP * code))[each], 0.0)
            unseen = np.flatnonzero((ids >= self.size) & (before >= 0) & (before < self.size))
            if len(unseen):  # words that no context has: what their context leaves to others
                p[unseen] *= self.left(before[unseen])
            # each found pair is the context of the token after it, within the text
            last = np.zeros(len(ids), bool)
            last[starts[1:] - 1] = last[-1:] = True
            at = np.flatnonzero(found & ~last[known])
            code, backoff = three.find(hi[at], node[at], ids[known[at] + 1].astype(np.int64))
            at = known[at] + 1
            p[at] = np.where(backoff > 0, 10.0 ** (-STEP * backoff), 1.0) * p[at] + np.where(code >= 0, 10.0 ** (-STEP * code), 0.0)
        sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), np.log10(one), np.log10(p))]
        return np.diff(np.append(starts, len(ids))), *sums

    def left(self, a: np.ndarray) -> np.ndarray:
        """Back-off weights of contexts of one word."""
        each, at = np.unique(a, return_inverse=True)
        two = self.levels[1]
        _, _, backoff = two.find(two.pair(each, np.full(len(each), self.size)))
        return np.where(backoff > 0, 10.0 ** (-STEP * backoff), 1.0)[at]


_OPEN: dict = {}


def opened(description: tuple) -> Model:
    """The model in this worker; one at a time is kept from task to task."""
    key = repr(description)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Model(*description)
    return _OPEN[key]


def shards(rows: DataFrame, key: str, build, label: str) -> list[tuple[int, int, str]]:
    """Writes range-partitioned rows as shards; their (first key, entries, path), few enough for the driver.
    ``build``: a task's sorted columns to (first key, entries, arrays)."""
    spark = rows.sparkSession
    folder = new_path(spark, label)
    n = max(1, -(-rows.count() // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(got[0].num_columns)]
            first, entries, parts = build(*columns)
            path = f"{folder}/{first}.ef"
            publish(path, to_bytes(parts))
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([entries]), pa.array([path])], ["first", "entries", "path"])

    made = rows.repartitionByRange(n, key).sortWithinPartitions(*rows.columns[:2]).mapInArrow(lean(run), "first long, entries long, path string")
    return sorted((r["first"], r["entries"], r["path"]) for r in made.collect())


def encoded(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple]:
    """The texts as ids, stored, one row per document: id, train, ids (32 bits for each token, the end token last); and the vocabulary's
    description, learnt from the rows that are ``trainable``."""
    words = vocabulary(docs.filter(trainable).select(F.col(text_col).alias("text")), "text")
    total, size = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if size >= 1 << 31:
        raise ValueError(f"{size} different words are too many")

    def first_level(h: np.ndarray, c: np.ndarray) -> tuple:
        keys = h.astype(np.int64).view(U64) - np.int64(h[0]).view(U64)
        return int(h[0]), len(h), {**EliasFano.build(keys, "keys"), "counts": c.astype(np.uint32 if c.max() < 1 << 32 else U64)}

    model = ([shards(words, "h", first_level, "lm1")], total, size)
    swept(docs.sparkSession, words)
    return as_ids(docs, model, trainable, id_col, text_col), model


def as_ids(docs: DataFrame, model: tuple, trainable: Column, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, end = opened(shared.value), END.encode()
        for b in batches:
            for part in (b.slice(k, 2000) for k in range(0, b.num_rows, 2000)):
                words: list[bytes] = []
                ends = [0]
                for text in part.column(2).to_pylist():
                    if text:
                        words += words_of(text)
                    words.append(end)
                    ends.append(len(words))
                ids = m.word_ids(words)
                ids = np.where(ids < 0, UNKNOWN, ids).astype("<u4")
                data = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.array(ends, np.int64) * 4), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), data.cast(pa.binary())], ["id", "train", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(trainable, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(lean(run), f"id {kind}, train boolean, ids binary"), "ids")


def tokens(batches: Iterator[pa.RecordBatch], column: int, of: int = BLOCK) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(batches, ids, where each text begins) of some million tokens at a time, a row at least."""

    def out() -> tuple:
        values = [x for b in held for x in b.column(column)]
        buffers = [np.frombuffer(x.as_buffer(), "<u4") for x in values]
        return held, np.concatenate(buffers), np.cumsum([0, *map(len, buffers[:-1])])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
            held.append(b)
            n += b.column(column).nbytes // 4
            if n >= of:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def windows(ids: np.ndarray, starts: np.ndarray, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, word) of the trigram around each token: the one before it (the end token before the first), itself and the next, padding after the last."""
    a, c = np.append(end, ids[:-1]).astype(U64), np.append(ids[1:], size).astype(np.int64)
    a[starts] = end
    c[starts[1:] - 1] = size
    return a << U64(size.bit_length()) | ids.astype(U64), c


def summed(hi: np.ndarray, c: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams, sorted and each once, and how often they are found."""
    low, bits = hi.min(), int(c.max()).bit_length()
    if (int(hi.max()) - int(low)).bit_length() + bits <= 64:  # one number holds both
        key = (hi - low) << U64(bits) | c.astype(U64)
        if n is None:
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        hi, c = (key[new] >> U64(bits)) + low, (key[new] & U64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.lexsort((c, hi))
        hi, c, n = hi[order], c[order], None if n is None else n[order]
        new = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (c[1:] != c[:-1])))
        size = len(hi)
        hi, c = hi[new], c[new]
        return hi, c, np.diff(np.append(new, size)) if n is None else np.add.reduceat(n, new)
    return hi, c, np.diff(np.append(new, len(key))) if n is None else np.add.reduceat(n, new)


def shrunk(hi: np.ndarray, c: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted trigrams and their counts, small: steps between pairs, how many words each has, words and counts in as few bytes as they take, compressed."""
    new = np.flatnonzero(np.append(True, hi[1:] != hi[:-1]))
    columns = [np.diff(hi[new], prepend=U64(0)), np.diff(np.append(new, len(hi))), c, n]
    parts = {}
    for name, x in zip(("pairs", "of", "c", "n"), columns, strict=True):
        x = x.astype("<u8")
        parts[name] = np.concatenate([(x >> U64(8 * k) & U64(255)).astype(np.uint8) for k in range(max(1, (int(x.max()).bit_length() + 7) // 8))])  # byte by byte
        parts[f"{name}.n"] = np.array([len(x)])
    data = to_bytes(parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unshrunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = from_bytes(pa.decompress(memoryview(data)[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))

    def column(name: str) -> np.ndarray:
        out = np.zeros(int(parts[f"{name}.n"][0]), U64)
        for k, x in enumerate(parts[name].reshape(-1, len(out))):
            out |= x.astype(U64) << U64(8 * k)
        return out

    return np.repeat(np.cumsum(column("pairs"), dtype=U64), column("of").astype(np.int64)), column("c").astype(np.int64), column("n").astype(np.int64)


#: Parts in which levels are made from counts, of which each part is deleted as it is done.
WAVES = 4
SUMMARY = "shard long, path string, first long, second long, last long, pairs long, first_n long, first_types long, last_n long, last_types long, a_types long, z_types long, first_c long"


def train(docs: DataFrame, trainable: Column, text_col: str = "text", id_col: str = "doc_id") -> tuple:
    """The model's description: levels as lists of shards, N and V."""
    return grown(*encoded(docs.filter(trainable), F.lit(True), id_col, text_col))


def grown(rows: DataFrame, vocabulary: tuple) -> tuple:
    """The model over the rows of ``encoded`` that are for training."""
    spark = rows.sparkSession
    (level1,), total, size = vocabulary
    texts = rows.filter("train").select("ids")
    if not total:
        return [level1, [], []], total, size
    bits, mask = size.bit_length(), (1 << size.bit_length()) - 1
    shared = spark.sparkContext.broadcast(([level1], total, size))
    n = max(1, -(-total // SHARD_TOKENS))
    folder = new_path(spark, "lm")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared.value)
        for _, ids, starts in tokens(batches, 0):
            hi, c = windows(ids, starts, m.end, size)
            at = np.random.default_rng(len(ids)).random(len(ids)) < SAMPLE * n / total
            yield pa.RecordBatch.from_arrays([pa.array(hi[at].view(np.int64)), pa.array(c[at])], ["hi", "c"])

    first_hi, first_c = np.zeros(0, U64), np.zeros(0, np.int64)
    if n > 1:
        few = texts.mapInArrow(lean(sampled), "hi long, c long").toPandas()
        hi, c = few["hi"].to_numpy().view(U64), few["c"].to_numpy()
        order = np.lexsort((c, hi))
        cut = order[(np.arange(1, n) * len(order)) // n] if len(order) else order
        first_hi, first_c, _ = summed(hi[cut], c[cut]) if len(cut) else (hi, c, None)
    n = len(first_hi) + 1
    bounds = spark.sparkContext.broadcast((first_hi, first_c))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared.value)
        for _, ids, starts in tokens(batches, 0):
            hi, c = windows(ids, starts, m.end, size)
            shard = range_of(hi, c, *bounds.value).astype(np.uint16 if n < 1 << 16 else np.int64)
            order = np.argsort(shard, kind="stable")
            ends = np.cumsum(np.bincount(shard, minlength=n))
            for k in np.flatnonzero(np.diff(ends, prepend=0)):
                at = order[ends[k - 1] if k else 0 : ends[k]]
                yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([shrunk(*summed(hi[at], c[at]))], pa.binary())], ["shard", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, got, waiting = None, None, []

        def merged() -> tuple:
            return summed(*(np.concatenate(x) for x in zip(*([got] if got else []), *waiting, strict=True)))

        for b in batches:
            for k, data in zip(*b.columns, strict=True):
                shard = k.as_py()
                waiting.append(unshrunk(data.as_py()))
                if sum(len(v[0]) for v in waiting) > BLOCK:
                    got, waiting = merged(), []
        if shard is None:
            return
        hi, c, m = merged() if waiting else got
        path = f"{folder}/counts-{shard}"
        publish(path, shrunk(hi, c, m))
        new = np.flatnonzero(np.append(True, hi[1:] != hi[:-1]))
        each, sums, types = hi[new], np.add.reduceat(m, new), np.add.reduceat((c < size).astype(np.int64), new)
        a = each >> U64(bits)
        row = (shard, path, int(each[0]), int(each[1]) if len(each) > 1 else -1, int(each[-1]), len(each), int(sums[0]), int(types[0]), int(sums[-1]), int(types[-1]), int((a == a[0]).sum()), int((a == a[-1]).sum()), int(c[0]))
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], pa.schema([(x, pa.string() if x == "path" else pa.int64()) for x in names]))

    names = [x.split()[0] for x in SUMMARY.split(", ")]
    blocks = texts.mapInArrow(lean(count), "shard long, counts binary").repartitionById(n, F.col("shard").cast("int"))
    found = sorted(blocks.mapInArrow(lean(gather), SUMMARY).collect(), key=lambda r: r["shard"])
    del blocks
    swept(spark)

    # totals of the contexts at the ends of shards
    pairs, types, base, rows_ = defaultdict(lambda: [0, 0]), Counter(), 0, []
    skips = [k > 0 and r["first"] == found[k - 1]["last"] for k, r in enumerate(found)]
    for skip, r in zip(skips, found, strict=True):
        for e, x in {r["first"]: "first", r["last"]: "last"}.items():
            pairs[e][0] += r[f"{x}_n"]
            pairs[e][1] += r[f"{x}_types"]
        for a, x in {r["first"] >> bits: "a", r["last"] >> bits: "z"}.items():
            types[a] += r[f"{x}_types"] - (skip and a == r["first"] >> bits)
    owned = [r["second"] if skip else r["first"] for skip, r in zip(skips, found, strict=True)]  # the first pair that begins in a shard, -1: none
    level2, level3 = [], []
    for k, (skip, r) in enumerate(zip(skips, found, strict=True)):
        following = next((x for x in owned[k + 1 :] if x >= 0), -1)
        after = found[k + 1]["first"] if k + 1 < len(found) else -1
        a_types = {a: types[a] for a in {r["first"] >> bits, r["last"] >> bits, following >> bits} if a >= 0}
        rows_.append((r["path"], int(skip), following, after, [pairs[r["first"]], pairs[r["last"]], pairs[after] if after >= 0 else [1, 0]], [[a, t] for a, t in a_types.items()], f"{folder}/2-{k}.ef", f"{folder}/3-{k}.ef"))
        if owned[k] >= 0:
            level2.append((owned[k], r["pairs"] - skip, rows_[-1][6]))
        level3.append((r["first"], r["first_c"], base - skip, rows_[-1][7]))
        base += r["pairs"] - skip

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared.value)
        for b in batches:
            for r in b.to_pylist():
                files, path = filesystem(r["path"])
                with files.open_input_stream(path, compression=None) as source:
                    hi, c, x = unshrunk(source.read())
                flag = np.append(True, hi[1:] != hi[:-1])
                new = np.flatnonzero(flag)
                each, sums, kinds = hi[new], np.add.reduceat(x, new), np.add.reduceat((c < size).astype(np.int64), new)
                (sums[0], kinds[0]), (sums[-1], kinds[-1]) = r["ends"][0], r["ends"][1]
                # bigrams that begin here, and all contexts up to the one that the next shard begins with
                own, whole = each[r["skip"] :], sums[r["skip"] :]
                if len(own):
                    a = (own >> U64(bits)).astype(np.int64)
                    first, last = int(a[0]), max(int(a[-1]), r["following"] >> bits if r["following"] >= 0 else 0)
                    many, count = np.bincount(a - first, minlength=last - first + 1), m.levels[0].values("counts", np.arange(first, last + 1))
                    pointers = np.append(0, np.cumsum(many))
                    for w, t in r["types"]:
                        if first <= w <= last:
                            many[w - first] = t
                    keys = (a - first).astype(U64) * U64(size + 1) + (own & U64(mask))
                    publish(r["two"], to_bytes({**EliasFano.build(keys, "words"), **EliasFano.build(pointers, "pointers"), "prob": quantised(np.log10((whole - DISCOUNT) / count[a - first])), "backoff": weights(many, count)}))
                # trigrams; padding is no word
                j = np.cumsum(flag) - 1
                real = np.flatnonzero(c < size)
                here = np.bincount(j[real], minlength=len(each))
                if r["after"] >= 0 and r["after"] != int(each[-1]):
                    sums, kinds, here = (np.append(v, t) for v, t in ((sums, r["ends"][2][0]), (kinds, r["ends"][2][1]), (here, 0)))
                keys = j[real].astype(U64) * U64(size + 1) + c[real].astype(U64)
                prob = quantised(np.log10((x[real] - DISCOUNT) / sums[j[real]]))
                publish(r["three"], to_bytes({**EliasFano.build(keys, "words"), **EliasFano.build(np.append(0, np.cumsum(here)), "pointers"), "prob": prob, "backoff": weights(kinds, sums)}))
                yield pa.RecordBatch.from_arrays([pa.array([r["two"]])], ["path"])

    schema = "path string, skip long, following long, after long, ends array<array<long>>, types array<array<long>>, two string, three string"
    for wave in (rows_[k :: WAVES] for k in range(min(WAVES, len(rows_)))):
        spark.createDataFrame(wave, schema).repartition(len(wave)).mapInArrow(lean(build), "path string").collect()
        for r in wave:
            path = spark._jvm.org.apache.hadoop.fs.Path(r[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return [level1, level2, level3], total, size


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score (unigrams) and score (the model), log10."""
    return scored(as_ids(docs, ([model[0][0]], *model[1:]), F.lit(False), id_col, text_col), model)


def scored(rows: DataFrame, model: tuple) -> DataFrame:
    """``score`` of the rows of ``encoded``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = opened(shared.value)
        for held, ids, starts in tokens(batches, 1, SCORED):
            out = m.score(ids, starts)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0) for b in held]), *(pa.array(x) for x in out)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return rows.select("id", "ids").mapInArrow(lean(run), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
