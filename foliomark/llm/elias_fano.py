"""Elias-Fano sequences and memory-mapped levels, in numpy."""

from __future__ import annotations

import tempfile

import numpy as np

#: Numbers whose bits are laid out at once while a sequence is built.
CHUNK = 65_536
#: Low bits that one unaligned 8-byte read can hold.
MOST_LOW = 56


class EliasFano:
    """A non-decreasing sequence of unsigned numbers, in about 2 + log2(range / count) bits each.

    The low bits of all numbers are laid end to end.  Their high parts are written in unary: a one for each
    number, a zero at the end of each bucket of numbers with the same high part.
    """

    def __init__(self, low_bits: int, count: int, low: np.ndarray, high: np.ndarray) -> None:
        self.low_bits, self.count, self.low, self.high = low_bits, count, low, high
        bits = np.unpackbits(np.asarray(high), bitorder="little")
        # where each bucket begins, for direct access
        ends = np.flatnonzero(bits == 0)
        self.starts = np.concatenate([[0], ends - np.arange(len(ends))]).clip(0, count)

    @staticmethod
    def parts(values: np.ndarray, top: int) -> tuple[int, np.ndarray, np.ndarray]:
        """low bits, and the bytes of both parts, for ascending uint64 ``values`` up to ``top``."""
        n = max(len(values), 1)
        bits = min(max(0, int(top // n).bit_length() - 1), MOST_LOW)
        width = np.arange(bits, dtype=np.uint64)
        low = np.zeros((len(values) * bits + 7) // 8 + 8, dtype=np.uint8)
        for i in range(0, len(values), CHUNK):  # CHUNK numbers fill whole bytes
            flat = ((values[i : i + CHUNK, None] >> width) & np.uint64(1)).astype(np.uint8).ravel()
            packed = np.packbits(flat, bitorder="little")
            low[i * bits // 8 : i * bits // 8 + len(packed)] = packed
        buckets = (values >> np.uint64(bits)).astype(np.int64)
        high = np.zeros(len(values) + (int(top) >> bits) + 1, dtype=np.uint8)
        high[buckets + np.arange(len(values))] = 1
        return bits, low, np.packbits(high, bitorder="little")

    def low_part(self, at: np.ndarray) -> np.ndarray:
        first = at * self.low_bits
        words = self.low[(first >> 3)[:, None] + np.arange(8)].view("<u8").ravel()
        return (words >> (first & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at some places."""
        high = np.searchsorted(self.starts, places, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low_part(places)

    def find(self, wanted: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of the successor of each wanted number (the first that isn't smaller), and so of the
        number itself if it is there: -1 if it isn't.  It is looked for from ``first`` up to before ``last`` only."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64).clip(0, len(self.starts) - 2)
        low = wanted & np.uint64((1 << self.low_bits) - 1)
        a, b = self.starts[high], self.starts[high + 1]
        if first is not None:
            a, b = np.maximum(a, first), np.maximum(a, np.minimum(b, last))
        end = b.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) >> 1
            less = self.low_part(middle) < low[open_]
            a[open_] = np.where(less, middle + 1, a[open_])
            b[open_] = np.where(less, b[open_], middle)
        found = np.flatnonzero(a < end)
        out = np.full(len(wanted), -1, dtype=np.int64)
        same = (self.low_part(a[found]) == low[found]) & ((wanted[found] >> np.uint64(self.low_bits)).astype(np.int64) == high[found])
        out[found[same]] = a[found[same]]
        return out


class Levels:
    """Named arrays in one file without a name, mapped into memory; gone when the last map is closed.

    The system keeps the pages in use in memory and may drop the others.
    """

    def __init__(self, **arrays: np.ndarray) -> None:
        with tempfile.TemporaryFile() as file:
            places = {}
            for name, a in arrays.items():
                file.write(b"\0" * (-file.tell() % 8))
                places[name] = (file.tell(), a.dtype, a.shape)
                file.write(np.ascontiguousarray(a).tobytes())
            file.write(b"\0" * 8)
            file.flush()
            self.maps = {
                n: np.memmap(file, dtype=kind, mode="r", offset=at, shape=shape) if np.prod(shape) else np.zeros(shape, kind)
                for n, (at, kind, shape) in places.items()
            }

    def __getitem__(self, name: str) -> np.ndarray:
        return self.maps[name]
