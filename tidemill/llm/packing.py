"""Best-fit packing with Martello-Toth dominance reduction.

Tokenising.  Byte-level BPE never merges across the pieces that its splitting pattern makes, and that pattern always
starts a new piece before a space that a non-space follows, and between a letter or digit and an ASCII mark other than the apostrophe,
and splits runs of white space by a simple rule.  So texts are cut there first, the ids of segments are remembered,
and a document is a join of remembered byte strings.  A segment of letters alone is one piece, so it goes to the tokenizer's
model without being split again.  Ids are kept as little-endian unsigned 32-bit numbers.

Packing.  A sequence holds ``CAPACITY`` tokens.  A longer document is cut into pieces of that many, the first piece
takes the remainder.  Lengths below the capacity are all that packing has to know, so it works on their histogram, which has
fewer than ``CAPACITY`` bars whatever the corpus: every step treats all pieces of one length at once.

1. Reduction (Martello and Toth): for a length, a small set that holds it and dominates every other set that holds it is
   fixed for good - alone if nothing fits beside it; with a partner that fills the sequence exactly; with the longest
   partner if no two others fit beside it, or if at most two fit and no two weigh more than that partner.  Repeated until
   nothing more can be fixed.
2. What is left is packed by decreasing length into the fullest sequence that has room (best fit).

The plan is a list of (pattern, number of sequences); its size depends on the number of different lengths, not on the number
of documents.  Pieces get a rank within their length by counting per (length, block of rows) and prefix sums over blocks,
so no length, however common, is ranked in one task; a rank then finds its place in the broadcast plan.

Defined results: a null text counts as empty and is one piece, the end token; rows may repeat and each is packed; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, stored

CAPACITY, END = 2048, 0
#: Pieces that one block holds, at most.
BLOCK = 8192
#: Letters and digits beyond doubt; ASCII marks but the apostrophe, which may lead a contraction; white space as the tokenizer
#: has it, without U+001C to U+001F, and all else.
_ALNUM, _MARK, _GAP, _INK = r"0-9A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~", r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: A space may lead a word or a run of marks that ends where the tokenizer starts a new piece for sure, or any other run of
#: non-spaces; of other white space all but the last goes together.
_SEGMENT = re.compile(rf" ?[{_ALNUM}]++(?=[{_MARK}]|{_GAP}|\Z)| ?[{_MARK}]++(?=[0-9A-Za-z]|{_GAP}|\Z)| ?{_INK}+|{_GAP}+(?!{_INK})|{_GAP}")
#: Bytes that a worker remembers segments in, unless told otherwise (three times as many save a fifth of the time), and the length of those that it does.
REMEMBERED, REMEMBERED_LENGTH = 32 << 20, 40
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def byte_letters() -> dict[int, int]:
    """How byte-level tokenizers write bytes: those that are visible in Latin-1 as themselves, the others as letters from U+0100 on, in order."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
    return {b: 256 + k for k, b in enumerate(hidden)}


class Generations(dict):
    """Text to bytes, remembered in two generations: when the younger takes half of ``limit``, it becomes the older, and what was in the older
    and wasn't asked for since is forgotten.  Long texts aren't remembered."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.half, self.bytes, self.older = make, limit // 2, 0, {}

    def __missing__(self, text: str) -> bytes:
        data = self.older.get(text) or self.make(text)
        if len(text) <= REMEMBERED_LENGTH:
            if self.bytes > self.half:
                self.older, self.bytes = self.copy(), 0
                self.clear()
            self[text] = data
            self.bytes += len(text) + len(data) + 180  # with the objects' heads and the table's slots
        return data


class Encoder:
    """Texts to the bytes of their ids, equal to what the tokenizer makes of the whole texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # what is one piece to a byte-level tokenizer can go to its model without more ado
        whole = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and isinstance(self.tokenizer.model, models.BPE) and self.tokenizer.normalizer is None
        self.letters = _LETTERS.fullmatch if whole else lambda _: None
        self.model, self.bytes = self.tokenizer.model, byte_letters()  # the attribute makes a new handle each time
        self.space = chr(self.bytes[ord(" ")])
        self.segments = Generations(self.ids, remembered)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, segment: str) -> bytes:
        if not self.letters(segment):
            return self.whole(segment)
        written = segment.replace(" ", self.space) if segment.isascii() else segment.encode().decode("latin-1").translate(self.bytes)
        return array("I", [x.id for x in self.model.tokenize(written)]).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        # special tokens are taken out before a text is split, so such a text goes whole
        known, segments = self.segments.__getitem__, _SEGMENT.findall
        return [self.whole(t) if any(s in t for s in self.special) else b"".join(map(known, segments(t))) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str, remembered: int) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(path, remembered)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: the remainder first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Stored, one row per piece: row (unique), id, piece, start, length, ids (bytes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(tokenizer, remembered), np.asarray([end], "<u4").tobytes()
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += tail
                    rows += [(0, doc_id.as_py(), k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["row", "id", "piece", "start", "length", "ids"])

    types = [pa.int64(), to_arrow_type(docs.schema[id_col].dataType), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "pieces")


class Plan:
    """Patterns of lengths and how many sequences use them, from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.left = capacity, {s: c for s, c in histogram.items() if c > 0}
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self.fixed = self.reduce()
        self.best_fit()

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        self.patterns.append((pattern, times))
        for s in pattern:
            self.left[s] -= times
            if not self.left[s]:
                del self.left[s]

    def reduce(self) -> int:
        """Fixes dominating sets; the number of pieces fixed."""
        fixed, changed = 0, True
        while changed and self.left:
            changed = False
            for s in sorted(self.left, reverse=True):
                while self.left.get(s) and (found := self.dominating(s)):
                    times = self.left[s] // found.count(s) if found.count(s) > 1 else min(self.left[x] for x in found)
                    if not times:
                        break
                    if 1 < len(found) and sum(found) < self.capacity:
                        times = min(times, self.stable(found))
                    self.take(found, times)
                    fixed, changed = fixed + times * len(found), True
        return fixed

    def stable(self, found: tuple[int, ...]) -> int:
        """How often a set that does not fill the sequence may be fixed before the argument must be made anew: the two or three
        shortest lengths must stay what they are, so all but two pieces of a length that is among them."""
        least = sorted(self.left)[:2]
        return max(1, min(self.left[x] - 3 * (x in least) for x in found))

    def dominating(self, s: int) -> tuple[int, ...] | None:
        room, sizes = self.capacity - s, sorted(self.left)
        own = {s: 1}

        def have(x: int) -> int:
            return self.left[x] - own.get(x, 0)

        k = bisect_right(sizes, room) - 1
        while k >= 0 and not have(sizes[k]):
            k -= 1
        if k < 0:
            return (s,)
        partner = sizes[k]
        if partner == room:
            return (s, partner)
        small: list[int] = []  # the three shortest others
        for x in sizes:
            small += [x] * min(3, have(x))
            if len(small) >= 3:
                break
        if len(small) < 2 or small[0] + small[1] > room:
            return (s, partner)
        if (len(small) < 3 or sum(small[:3]) > room) and partner >= self.best_pair(sizes, room, have):
            return (s, partner)
        return None

    @staticmethod
    def best_pair(sizes: list[int], room: int, have) -> int:
        best, i, j = 0, 0, len(sizes) - 1
        while i <= j:
            a, b = sizes[i], sizes[j]
            if not have(a) or (i == j and have(a) < 2):
                i += 1
            elif not have(b) or a + b > room:
                j -= 1
            else:
                best, i = max(best, a + b), i + 1
        return best

    def best_fit(self) -> None:
        """Whole bars at once: of the open sequences with room, the fullest first; each such group is extended or split."""
        rooms: list[int] = []  # sorted
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

        def put(pattern: tuple[int, ...], times: int) -> None:
            room = self.capacity - sum(pattern)
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
                open_[room] = []
            open_[room].append((pattern, times))

        for s in sorted(self.left, reverse=True):
            count = self.left[s]
            while count:
                at = bisect_left(rooms, s)
                if at == len(rooms):  # none has room: new ones, filled with as many of this length as fit, as one after another would be
                    each = self.capacity // s
                    full, rest = divmod(count, each)
                    if full:
                        put((s,) * each, full)
                    if rest:
                        put((s,) * rest, 1)
                    count = 0
                    break
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                each = room // s  # as each extension makes it the fullest
                use = min(times, count // each)
                if use:
                    put(pattern + (s,) * each, use)
                    count -= use * each
                    times -= use
                if times and count and count < each:
                    put(pattern + (s,) * count, 1)
                    times, count = times - 1, 0
                if times:
                    put(pattern, times)
        for groups in open_.values():
            self.patterns += groups
        self.left = {}

    def arrays(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: first rank, first sequence and offset of each of its slots, by rank."""
        slots: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for pattern, times in self.patterns:
            offset = 0
            for s in pattern:
                slots.setdefault(s, []).append((ranks.get(s, 0), sequence, offset))
                ranks[s] = ranks.get(s, 0) + times
                offset += s
            sequence += times
        return {s: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for s, v in slots.items()}

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def placements(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """row, sequence_id, offset of each piece of a stored table ``pieces``."""
    few = pieces.select("row", "length")
    bars = {r["length"]: r["count"] for r in few.groupBy("length").count().collect()}  # fewer than the capacity
    places = few.sparkSession.sparkContext.broadcast(Plan(bars, capacity).arrays())
    blocks = max(16, -(-sum(bars.values()) // BLOCK))
    few = few.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    counts = few.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = few.join(counts, ["length", "block"]).select("row", "length", (F.col("before") + F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = places.value
        for b in batches:
            lengths, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                first, number, offsets = plan[int(lengths[at[0]])]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = number[k] + rank[at] - first[k], offsets[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(run), "row long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: id, piece, start, length, sequence_id, offset, and ``ids``, an expression over the bytes of the
    ids (by default they themselves); if it makes them smaller, less is moved.  ``remembered``: bytes of a worker's memory of segments."""
    each = pieces(docs, tokenizer, capacity, end, id_col, text_col, remembered)
    where = placements(each, capacity)
    return each.select("row", "id", "piece", "start", "length", F.expr(ids).alias("ids")).join(where, "row").drop("row")
