"""Monotone numbers in Elias-Fano code, read from memory-mapped files, many at a time.

Of n numbers below u the lower ``log2(u / n)`` bits stand side by side; the upper parts are a bit vector in which number i sets bit
``upper + i``. The ones before every 64th bit are kept beside it, so a bit's place is found by one search and one word.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

from tradewind.llm.shared import file_system, new_file

HEAD_BYTES = 4096


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of ascending unsigned 64-bit numbers below ``universe``."""
    n = len(values)
    values = values.astype(np.uint64)
    bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
    planes = np.empty((n, bits), bool)
    for k in range(bits):
        planes[:, k] = values >> np.uint64(k) & np.uint64(1)
    low = np.concatenate([np.packbits(planes.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
    place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    size = (n + ((universe - 1) >> bits) + 2 if universe else 1) + 63 & ~63
    marks = np.zeros(size, bool)
    marks[place] = True
    high = np.packbits(marks, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype("<u4")
    return {"shape": np.array([n, bits], "<i8"), "low": low, "high": high, "ones": ones}


def _kth(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each 64-bit word."""
    place, k = np.zeros(len(word), np.uint64), k.astype(np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        w = np.uint64(width)
        below = np.bitwise_count(word >> place & (np.uint64(1) << w) - np.uint64(1)).astype(np.uint64)
        right = k >= below
        k -= np.where(right, below, np.uint64(0))
        place += np.where(right, w, np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits = (int(x) for x in shape)
        self.low = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # a word from every byte on
        self.high, self.ones = high, ones
        self.mask = np.uint64((1 << self.bits) - 1)
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return self.low[at >> 3] >> (at & 7).astype(np.uint64) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _kth(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def _up_to(self, upper: np.ndarray) -> np.ndarray:
        """How many numbers have an upper part up to this one; none for -1."""
        u = np.maximum(upper, 0)
        word = np.minimum(np.searchsorted(self.zeros, u, "right") - 1, len(self.high) - 1)
        place = word * 64 + _kth(~self.high[word], u - self.zeros[word])
        return np.where(upper < 0, 0, np.minimum(place - u, self.n))

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first number that is not below each value."""
        upper = (values >> np.uint64(self.bits)).astype(np.int64)
        upper = np.minimum(upper, max(0, int(self.zeros[-1]) - 1))
        lower = values & self.mask
        lo, hi = self._up_to(upper - 1), self._up_to(upper)
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < lower[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        return lo

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is missing."""
        if not self.n:
            return np.full(len(values), -1)
        at = self.successor(values)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.get(inside) == values), at, -1)


# ---- files of named arrays ----------------------------------------------------------------------------------


def write(folder: str, name: str, sequences: dict[str, dict[str, np.ndarray]], **plain: np.ndarray) -> str:
    """A file with sequences and plain arrays, each from a place divisible by 8."""
    path = new_file(folder, name) + ".ef"
    fs, place = file_system(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    arrays = {f"{s}.{k}": a for s, parts in sequences.items() for k, a in parts.items()} | plain
    at, index = HEAD_BYTES, {}
    for k, a in arrays.items():
        index[k] = [at, a.dtype.str, len(a)]
        at += a.nbytes + 7 & ~7
    with fs.open_output_stream(place, compression=None) as out:
        out.write(json.dumps(index).encode().ljust(HEAD_BYTES))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes().ljust(a.nbytes + 7 & ~7, b"\0"))
    return path


class File:
    """Memory-mapped where the shared folder is a mounted one; read whole from other stores."""

    def __init__(self, path: str):
        fs, place = file_system(path)
        if isinstance(fs, pafs.LocalFileSystem):
            raw = np.frombuffer(pa.memory_map(place).read_buffer(), np.uint8)
        else:
            raw = np.frombuffer(fs.open_input_file(place).read(), np.uint8)
        index = json.loads(raw[:HEAD_BYTES].tobytes())
        self.arrays = {k: raw[at : at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in index.items()}

    def sequence(self, name: str) -> EliasFano:
        return EliasFano(*(self.arrays[f"{name}.{k}"] for k in ("shape", "low", "high", "ones")))
