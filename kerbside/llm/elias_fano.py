"""Elias-Fano: a non-decreasing list of integers in about 2 + log2(range / count) bits each, with selection by index."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QQBQ")  # count, largest value, low bits, bytes of the high part
#: One in so many set bits has its position kept; a selection scans at most that many more.
STEP = 256


class EliasFano:
    """values[i] = (position of the i-th set bit - i) << low | low bits of i."""

    def __init__(self, count: int, top: int, low: int, high: np.ndarray, lows: np.ndarray):
        self.count, self.top, self.low, self.high, self.lows = count, top, low, high, lows
        self._set_before = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        count, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // count).bit_length() - 1) if count else 0
        bits = np.zeros((top >> low) + count + 1, dtype=np.uint8)
        bits[(v >> np.uint64(low)).astype(np.int64) + np.arange(count)] = 1
        each = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(count, top, low, np.packbits(bits, bitorder="little"), np.packbits(each.reshape(-1), bitorder="little"))

    def to_bytes(self) -> bytes:
        return HEAD.pack(self.count, self.top, self.low, len(self.high)) + self.high.tobytes() + self.lows.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The list that begins at a byte, and the byte after it."""
        count, top, low, n = HEAD.unpack_from(data, at)
        at += HEAD.size
        m = (count * low + 7) // 8
        return (cls(count, top, low, np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, m, at + n)),
                at + n + m)

    def _samples(self) -> np.ndarray:
        """The bit position of every STEP-th set bit: 32 bits each, made once when first needed."""
        if self._set_before is None:
            kind = np.uint32 if len(self.high) < 2 ** 29 else np.uint64
            self._set_before = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[::STEP].astype(kind)
        return self._set_before

    def select(self, i: int) -> int:
        """Value i, from the sample before it and a scan of fewer than STEP set bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        samples = self._samples()
        at = int(samples[i // STEP])
        end = int(samples[i // STEP + 1]) + 1 if i // STEP + 1 < len(samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[at // 8:end // 8 + 1], bitorder="little")[at % 8:]
        position = at + int(np.flatnonzero(bits)[i % STEP])
        return (position - i) << self.low | int(self._low_of(np.array([i]))[0])

    def _low_of(self, index: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(index), dtype=np.uint64)
        bit = index[:, None] * self.low + np.arange(self.low)
        each = (self.lows[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return (each.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def all(self) -> np.ndarray:
        """Every value, in order."""
        index = np.arange(self.count)
        set_bits = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((set_bits - index).astype(np.uint64) << np.uint64(self.low)) | self._low_of(index)
