"""Elias-Fano sequences over memory maps, with vectorised access and successor search, and the files that hold them."""

from __future__ import annotations

import json
import mmap
import os
import tempfile

import numpy as np

from .common import filesystem

U64 = np.uint64


#: In each byte, the place of the bit that has so many set bits before it.
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()
_1, _2, _4, _EACH, _TOP = (U64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))


def select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the bit that has ``rank`` set bits before it, in each of the words: first its byte, then the place in it.  The set bits up to each
    byte are summed, and compared with the rank, in all eight bytes at once."""
    s = words - ((words >> U64(1)) & _1)
    s = (s & _2) + ((s >> U64(2)) & _2)
    upto = ((s + (s >> U64(4))) & _4) * _EACH
    r = rank.astype(U64)
    less = (((r * _EACH) | _TOP) - upto) & _TOP  # of bytes up to which there are no more than ``rank``
    byte = np.minimum(np.bitwise_count(less), 7).astype(U64) * U64(8)
    left = r - (((upto << U64(8)) >> byte) & U64(255))
    return byte.astype(np.int64) + _IN_BYTE[(((words >> byte) & U64(255)) * U64(8) + (left & U64(7))).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts in unary, with a directory of counts for select."""

    def __init__(self, parts: dict[str, np.ndarray], name: str):
        self.n, self.l = (int(x) for x in parts[f"{name}.size"])
        self.low, self.high, self.ones, self.zeros = (parts[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros"))

    @staticmethod
    def build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        v = values.astype(U64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        l = max(0, (top // max(1, n)).bit_length() - 1)
        packed = []
        for i in range(0, n, 1 << 15):  # a multiple of 64 values fills whole words
            part = v[i : i + (1 << 15)]
            packed.append(np.packbits(((part[:, None] >> np.arange(l, dtype=U64)) & U64(1)).astype(np.uint8), bitorder="little") if l else np.zeros(0, np.uint8))
        low = np.concatenate([*packed, np.zeros(0, np.uint8)])
        low = np.append(low, np.zeros(16 + -len(low) % 8, np.uint8)).view(U64)
        place = (v >> U64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(place[-1]) if n else 0) // 64 * 64 + 192, np.uint8)  # at least a word of zeros follows
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return {f"{name}.size": np.array([n, l], np.int64), f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones, f"{name}.zeros": 64 * np.arange(len(ones)) - ones}

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U64)
        bit = i * self.l
        word, off = bit >> 6, (bit & 63).astype(U64)
        value = self.low[word] >> off
        carry = self.low[word + 1] << ((U64(64) - off) & U64(63))
        return (value | np.where(off > 0, carry, U64(0))) & U64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + select(self.high[word], i - self.ones[word])
        return ((place - i).astype(U64) << U64(self.l)) | self.lows(i)

    def starts(self, h: np.ndarray) -> np.ndarray:
        """Number of values whose high part is less than h."""
        z = np.maximum(h - 1, 0)
        last = int(self.zeros[-1]) - 1
        z = np.minimum(z, last)
        word = np.searchsorted(self.zeros, z, "right") - 1
        place = word * 64 + select(~self.high[word], z - self.zeros[word])
        return np.where(h <= 0, 0, np.minimum(place - z, self.n))

    def bucket(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end place of the values whose high part is that of x, and x's low part.  A bucket's values are the set bits that follow
        one another after the zero of the bucket before."""
        h = np.minimum(x >> U64(self.l), U64(1 << 62)).astype(np.int64)
        first = self.starts(h)
        bit = np.minimum(first + h, len(self.high) * 64 - 128)
        word, off = bit >> 6, (bit & 63).astype(U64)
        ahead = self.high[word] >> off | np.where(off > 0, self.high[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        n = np.bitwise_count(ahead & ~(ahead + U64(1))).astype(np.int64)
        end = np.minimum(first + n, self.n)
        if len(more := np.flatnonzero(n == 64)):
            end[more] = self.starts(h[more] + 1)
        return first, end, x & U64((1 << self.l) - 1)

    def search(self, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
        """In each bucket, the first place whose low part is at least ``low``, or the bucket's end."""
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self.lows(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        return a

    def successor(self, x: np.ndarray, first: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """The first place in [first, end) whose value is at least x, or end."""
        a, b, low = self.bucket(x)
        return self.search(np.clip(a, first, end), np.clip(b, first, end), low)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The places of values, -1 for those that are not there: the successor is the value if it lies in its bucket and has its low part."""
        a, b, low = self.bucket(x)
        place = self.search(a, b, low)
        there = place < b
        there[there] = self.lows(place[there]) == low[there]
        return np.where(there, place, -1)


def to_bytes(parts: dict[str, np.ndarray]) -> bytes:
    head, at = {}, 0
    for k, v in parts.items():
        head[k] = (v.dtype.str, at, len(v))
        at += v.nbytes + -v.nbytes % 8
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    return b"".join([len(top).to_bytes(8, "little"), top, *(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in parts.values())])


def from_file(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, over a memory map.  A file that is not on a mounted file system is first copied to a local one that
    has no name any more, and goes with the process."""
    files, path = filesystem(uri)
    if os.path.exists(path):
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, files.open_input_stream(path, compression=None) as source:
            while part := source.read(1 << 22):
                f.write(part)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return from_bytes(data)


def from_bytes(data) -> dict[str, np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, np.dtype(t), n, 8 + size + at) for k, (t, at, n) in json.loads(data[8 : 8 + size]).items()}
