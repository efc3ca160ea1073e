"""Near-duplicate detection by min-max hashing.

A document is the set of its distinct word shingles, as 64-bit hashes.  For each of ``PERMUTATIONS`` random
permutations both the smallest and the largest value are kept; each agrees between two sets with their Jaccard
similarity as probability, so half the hash evaluations give as many signature values.  Bands of ``ROWS`` values are
bucket keys.  At similarity 0.8 a pair shares none of the 44 bands with probability 3e-8.

Equal sets are one *node* (a 64-bit digest, verified by a second one), so copies cost one row whatever their number.
Links between nodes are confirmed on full sets, never on signatures.  What is wanted are components, so pairs already
connected need no look:

1. In each bucket every node is held against one node only (a star), the one whose buckets are largest: it is near
   the middle of its group.  Each node first confirms the star link with the most shared bands, and components of confirmed links are found.
2. The other star links are confirmed where they would join two components.  Then, in each bucket where components still meet, a node of
   the largest is drawn, and nodes of the others are held against it: up to 44 draws for each node.
3. Whatever nodes share a bucket, may be similar enough and still lie in different components are put into clusters, and within a
   cluster all such pairs are compared on full sets.  Both are done in blocks of bounded size: rows are nodes, never pairs, and what comes out are
   edges and links that connect, fewer than nodes.

A pair is left out without a look at its sets only if the sizes rule it out, or if fewer than ``LEAST_AGREEING`` of its 220
signature values agree in ``BITS`` bits of each, seven standard deviations below what similarity 0.8 gives.

Components come from propagating smallest labels with pointer jumping over stored tables.  Nothing is collected to the
driver but counts.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is its own component;
a text with fewer words than a shingle has its whole sequence as one; a null id counts as larger than all others; rows
that repeat, or share an id, are linked like any others; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import addressed, lean, Remembered, stored, without

SHINGLE, SIMILARITY = 5, 80
BANDS, ROWS = 44, 5
PERMUTATIONS = BANDS * ROWS // 2
LEAST_AGREEING = 138
#: Bits of each signature value that are kept, and the longs that hold them.
BITS = 4
LONGS = -(-2 * PERMUTATIONS * BITS // 64)
PADDING = 64 * LONGS // BITS - 2 * PERMUTATIONS
BIT_COLUMNS = [f"b{k}" for k in range(LONGS)]
_LOWEST = 0x1111111111111111
#: Bytes of a shingle's hash that are kept for confirming.
WIDTH = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(similarity: int) -> tuple[int, int, int]:
    """Bands, rows and least values that agree: those above from 80 on; for less, so few rows that a pair shares no band with probability
    3e-8 at most, and seven standard deviations below what the similarity gives."""
    if similarity >= SIMILARITY:
        return BANDS, ROWS, LEAST_AGREEING
    s, n = similarity / 100, 2 * PERMUTATIONS
    p = s + (1 - s) / (1 << BITS)
    for rows in range(ROWS, 0, -1):
        if (1 - s**rows) ** (n // rows) <= 3e-8:
            return n // rows, rows, int(n * p - 7 * (n * p * (1 - p)) ** 0.5)
    raise ValueError(f"similarity {similarity} is too low for {n} signature values")


def shingles(text: str, n: int, hashes: Remembered) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    if not n:
        return h
    with np.errstate(over="ignore"):
        s = h[: len(h) - n + 1] + np.uint64(n)
        for k in range(1, n):
            s = (s ^ (s >> np.uint64(29))) * _M1 + h[k : len(h) - n + 1 + k]
        s = (s ^ (s >> np.uint64(32))) * _M2
        return np.unique(s ^ (s >> np.uint64(29)))


class Signer:
    def __init__(self, seed: int = 5, similarity: int = SIMILARITY):
        draw = np.random.default_rng(seed)
        self.bands, self.rows, _ = shape(similarity)
        self.a = draw.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = draw.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
        self.mix = draw.integers(0, 1 << 63, (self.bands, self.rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys, and the signature's bits, ``BITS`` of each value, in ``LONGS`` numbers."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        least, most = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
        with np.errstate(over="ignore"):
            for i in range(0, len(x), 4096):
                v = self.a[:, None] * x[None, i : i + 4096] + self.b[:, None]
                least, most = np.minimum(least, v.min(1)), np.maximum(most, v.max(1))
            signature = np.concatenate([least, most])
            v = (signature[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64) * self.mix).sum(1, dtype=np.uint64)
            keys = ((v ^ (v >> np.uint64(31))) + np.arange(self.bands, dtype=np.uint64)) * _M1
            bits = ((signature ^ (signature >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        bits = np.append(bits, np.zeros(PADDING, np.uint32)).astype(np.uint64).reshape(LONGS, -1)
        return keys.view(np.int64), (bits << np.arange(0, 64, BITS, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def packed(s: np.ndarray) -> bytes:
    return np.ascontiguousarray((s >> np.uint64(64 - 8 * WIDTH)).view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return out.view(np.uint64).ravel()


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str, salt: int, similarity: int, address: bool) -> DataFrame:
    """Stored, one row per document: row, id, n, node, check, keys, the signature's bits, members (the packed set), and file and at if they are asked for."""
    kind = docs.schema[id_col].dataType
    place = [("file", pa.int64()), ("at", pa.int64())] if address else []
    schema = f"id {kind.simpleString()}, {''.join(f'{c} long, ' for c, _ in place)}n long, node long, check long, keys array<long>, {' long, '.join(BIT_COLUMNS)} long, members binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = Remembered(xxhash.xxh64_intdigest), Signer(similarity=similarity)
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                rows: list[tuple] = []
                for text in part.column(1).to_pylist():
                    s = shingles(text or "", n, hashes)
                    if not len(s):
                        rows.append((0, *[None] * (3 + LONGS + 1)))
                        continue
                    keys, bits = sign(s)
                    data = s.tobytes()
                    node, check = (np.array([xxhash.xxh3_64_intdigest(data, seed=2 * salt + k) for k in (0, 1)], np.uint64).view(np.int64)).tolist()
                    rows.append((len(s), node, check, keys, *bits.tolist(), packed(s)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(to_arrow_type(kind)), *(part.column(2 + k) for k in range(len(place))), *columns], names)

    types = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.int64()] * LONGS + [pa.binary()]
    names = ["id", *(c for c, _ in place), "n", "node", "check", "keys", *BIT_COLUMNS, "members"]
    own = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    out = (addressed(docs, *own)[1] if address else docs.select(*own)).mapInArrow(lean(run), schema)
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "signatures")


def agreeing(x: str, y: str) -> F.Column:
    """Signature values that agree in two rows, in the bits that are kept."""

    def unlike(k: str) -> Column:
        d = F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(_LOWEST)))

    return F.lit(2 * PERMUTATIONS) - sum((unlike(k) for k in BIT_COLUMNS), F.lit(0))


def unlike_values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signature values that differ: of rows of (n, LONGS) and one of (LONGS)."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(_LOWEST)).sum(-1, dtype=np.int64)


def alike(x: str, y: str, similarity: int) -> F.Column:
    """What similarity needs of sizes and signature bits."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(a, b) >= similarity * F.greatest(a, b)) & (agreeing(x, y) >= shape(similarity)[2])


def confirmed(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Stored, those of the pairs (a, b) whose full sets are similar enough."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                keep = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = unpacked(x.as_py()), unpacked(y.as_py())
                    common = len(np.intersect1d(x, y, assume_unique=False))
                    keep.append(100 * common >= similarity * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(lean(run), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """Stored, (node, label): the smallest node of the component, for each node that has an edge (a, b)."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = stored(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label")), "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("to"))
        lower = stored(lower.join(jump, lower["label"] == jump["at"]).select("node", F.col("to").alias("label")), "labels")
        before = labels.select(F.col("node").alias("at"), F.col("label").alias("was"))
        if lower.join(before, lower["node"] == before["at"]).filter("label <> was").isEmpty():
            return lower
        labels = lower


def grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[dict]:
    """Groups of rows that agree in the first ``by`` columns, of batches in which they follow one another; as arrays by name."""
    held: list[pa.RecordBatch] = []

    def out() -> dict:
        t = pa.Table.from_batches(held).combine_chunks()
        return {n: t.column(n).to_pylist() if pa.types.is_binary(t.schema.field(n).type) else t.column(n).to_numpy() for n in t.column_names}

    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(by)]
        cuts = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()
        for x, y in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if held and any(held[-1].column(k)[0].as_py() != keys[k][x] for k in range(by)):
                yield out()
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield out()


def blocks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """``rows`` dealt in pairs (i, j) of blocks of about ``size`` rows of each group, sorted by group and pair; first columns: group, i, j.
    No task gets more than two blocks, whatever the size of a group."""
    counts = stored(rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("of")).filter("of > 1"), "large")
    dealt = rows.join(counts, group, "left").withColumn("of", F.coalesce("of", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(group)), F.col("of")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    names = [c for c in rows.columns if c != group]
    dealt = dealt.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *names)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, group, "i", "j").sortWithinPartitions(group, "i", "j")


def possible(g: dict, similarity: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a group, the later rows with another label that it may be similar enough to; of two blocks, those of the other."""
    bits = np.stack([g[k] for k in BIT_COLUMNS], 1).view(np.uint64)
    least = shape(similarity)[2]
    n, label, own, two = g["n"], g["label"], g["own"], g["i"][0] != g["j"][0]
    for x in range(len(n) - 1):
        y = np.flatnonzero((label[x + 1 :] != label[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= similarity * np.maximum(n[x + 1 :], n[x])) & ((own[x + 1 :] != own[x]) | (not two))) + x + 1
        if len(y):
            y = y[2 * PERMUTATIONS - unlike_values(bits[y], bits[x]) >= least]
            if len(y):
                yield x, y


class Joined(dict):
    """Labels that links have joined, each to a smaller one."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)  # to the one above, before x itself changes
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)
        return x != y


def pairs_of(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def neighbours(rows: DataFrame, similarity: int) -> DataFrame:
    """Stored edges (a, b), fewer than rows that come in, that connect whatever nodes of one bucket (key) may be linked across components:
    of what a task connects, each node is tied to the smallest one, so that buckets with the same nodes give the same edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 3):
            node, joined = g["node"].tolist(), Joined()
            for x, ys in possible(g, similarity):
                for y in ys.tolist():
                    joined.join(node[x], node[y])
            b = [x for x in set(node) if joined.root(x) != x]
            yield pairs_of([joined.root(x) for x in b], b)

    return stored(blocks(rows, "key", 2048).mapInArrow(lean(run), "a long, b long").distinct(), "neighbours")


def compared(rest: DataFrame, bits: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Stored links (a, b) that join the components of nodes of one cluster: all pairs that are not ruled out are compared on full sets, but those
    whose components a link found before has joined.  What moves are the nodes' sets, once for each block of their cluster, and no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 3):
            members, joined, a, b = [np.sort(unpacked(m)) for m in g["members"]], Joined(), [], []
            node, label = g["node"].tolist(), g["label"].tolist()
            for x, ys in possible(g, similarity):
                ys = [y for y in ys.tolist() if joined.root(label[x]) != joined.root(label[y])]
                for part in (ys[k : k + 256] for k in range(0, len(ys), 256)):
                    size = np.array([len(members[y]) for y in part])
                    everything = np.concatenate([members[y] for y in part])
                    at = np.minimum(np.searchsorted(members[x], everything), len(members[x]) - 1)
                    common = np.add.reduceat((members[x][at] == everything).astype(np.int64), np.append(0, np.cumsum(size)[:-1]))
                    for k in np.flatnonzero(100 * common >= similarity * (size + len(members[x]) - common)).tolist():
                        if joined.join(label[x], label[part[k]]):
                            a.append(node[x])
                            b.append(node[part[k]])
            yield pairs_of(a, b)

    rows = rest.join(bits, "node").join(sets, "node").select("cluster", "node", "label", "n", *BIT_COLUMNS, "members")
    return stored(blocks(rows, "cluster", 256).mapInArrow(lean(run), "a long, b long"), "links")


def linked(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, row, n_shingles, component_id (the smallest id of its component), kept."""
    return grouped_rows(docs, n, similarity, id_col, text_col).drop("group")


def grouped_rows(docs: DataFrame, n: int, similarity: int, id_col: str, text_col: str, address: bool = False) -> DataFrame:
    """``linked`` with group: a number of the component, null for what has an empty set or no copy and no link; and the row's address if it is asked for."""
    place = ["file", "at"] if address else []
    for salt in range(8):
        docs_sigs = signatures(docs, n, id_col, text_col, salt, similarity, address)
        sigs = docs_sigs.filter("node IS NOT NULL")
        ids = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
        node = sigs.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(ids).alias("least"), F.min("row").alias("first"), F.min("check").alias("c"), F.max("check").alias("d"))
        many = stored(node.filter("copies > 1"), "copies")
        if many.filter("c <> d").isEmpty():
            break
    # one row stands for each node
    first = many.select(F.col("node").alias("of_node"), F.col("first"))
    one = sigs.join(first, sigs["node"] == first["of_node"], "left").filter("first IS NULL OR first = row")
    reps = stored(one.select("node", "n", *BIT_COLUMNS, "keys"), "nodes")
    bits = reps.drop("keys")

    rows = reps.select("node", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = stored(rows.join(stored(buckets, "buckets"), "key"), "members")  # of buckets with two nodes or more
    central = rows.groupBy("node").agg(F.sum("size").alias("central"))
    lead = rows.join(central, "node").groupBy("key").agg(F.max(F.struct("central", "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"))
    stars = rows.join(stored(lead, "leads"), "key").filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("bands"))
    stars = stars.join(bits.alias("x"), F.col("x.node") == stars["node"]).join(bits.alias("y"), F.col("y.node") == stars["lead"]).filter(alike("x", "y", similarity))
    stars = stored(stars.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), "bands"), "stars")
    sets = one.select("node", "members")
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("bands", "b")).alias("b"))
    links = confirmed(best, sets, similarity)

    def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs that would join two components."""
        la, lb = (labels.select(F.col("node").alias(f"n{k}"), F.col("label").alias(f"l{k}")) for k in "ab")
        with_ = pairs.join(la, F.col("a") == F.col("na"), "left").join(lb, F.col("b") == F.col("nb"), "left")
        return with_.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    def unsettled(labels: DataFrame) -> DataFrame:
        """Stored, the rows of buckets in which components meet, with their labels."""
        of = labels.select(F.col("node").alias("at"), "label")
        each = rows.join(of, rows["node"] == of["at"], "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        met = each.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("key")
        return stored(each.join(stored(met, "met"), "key"), "unsettled")

    labels = components(links)
    links = links.union(confirmed(stored(across(stars.join(best, ["a", "b"], "left_anti"), labels), "stars"), sets, similarity))
    labels = components(links)

    # one node of the largest component in a bucket, chosen anew for each, against the nodes of the others
    rest = unsettled(labels)
    main = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.xxhash64("node", "key").alias("draw"), "node")).alias("lead")).groupBy("key").agg(F.max(F.struct("n", "label", "lead.node")).alias("m"))
    main = stored(main.select("key", F.col("m.label").alias("main"), F.col("m.node").alias("lead")), "leads")
    tries = rest.join(main, "key").filter("label <> main").select("node", "lead").distinct()
    tries = tries.join(bits.alias("x"), F.col("x.node") == tries["node"]).join(bits.alias("y"), F.col("y.node") == tries["lead"]).filter(alike("x", "y", similarity))
    tries = stored(tries.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "tries")
    links = links.union(confirmed(tries, sets, similarity))
    labels = components(links)

    # whatever may still join two components, compared in full
    clusters = components(neighbours(unsettled(labels).select("key", "node", "label").join(bits, "node"), similarity))
    of = labels.select(F.col("node").alias("at"), "label")
    rest = clusters.select("node", F.col("label").alias("cluster")).join(of, F.col("node") == F.col("at"), "left").select("node", "cluster", F.coalesce("label", "node").alias("label"))
    last = compared(stored(rest, "rest"), bits, sets, similarity)
    if not last.isEmpty():
        links = links.union(last)
        labels = components(links)

    # the smallest id of each component, for nodes that have copies or links
    of = labels.select(F.col("node").alias("at"), "label")
    least = node.select("node", "least", "copies").join(of, F.col("node") == F.col("at"), "left").filter("copies > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node"))
    least = stored(least.select("node", "label", "least"), "least")
    top = stored(least.groupBy("label").agg(F.min("least").alias("top")), "top")
    found = stored(least.select("node", "label").join(top, "label").select(F.col("node").alias("of_node"), F.col("label").alias("group"), F.col("top.id").alias("component_id"), F.lit(True).alias("found")), "components")
    out = docs_sigs.select("row", "id", *place, "n", "node").join(found, F.col("node") == F.col("of_node"), "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "group", *place)


def deduplicate(docs: DataFrame, n: int = SHINGLE, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one row of each component: that of the smallest id, null last, of these the first row.  Rows are told apart
    by their address, so ids that repeat or are null are safe.  Texts stay where they are while few rows go (``common.BROADCAST_ROWS``)."""
    docs, _ = addressed(docs)
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    rows = stored(grouped_rows(docs, n, similarity, id_col, text_col, address=True).filter("group IS NOT NULL").select("group", rank.alias("rank"), "file", "at"), "grouped")
    first = stored(rows.groupBy("group").agg(F.min("rank").alias("first")), "first")
    gone = rows.join(first, "group").filter("rank <> first").select("file", "at")
    return without(docs, stored(gone, "gone"))
