"""Minimal perfect hash of 128-bit keys as bit arrays, with compact arrays beside it."""

from __future__ import annotations

import numpy as np

from bankspark.llm.words import mixed

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIX, _LAST, _ONE, _HALF = np.uint64(6), np.uint64(63), np.uint64(1), np.uint64(32)


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = mixed(high ^ mixed(low + np.uint64(level + 1) * _STEP))
    return ((value >> _HALF) * np.uint64(size)) >> _HALF


class PerfectHash:
    """Gives each of n distinct keys (two unsigned 64-bit halves) its own number from 0 to n - 1.

    Each level has two bits per key that is left; a key that falls on a bit alone stays there, the others
    go on to the next level. A key's number is how many bits are set before its own. Other keys get -1 or
    the number of some key.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        if len(np.unique(np.stack([high, low], 1), axis=0)) != len(high):
            raise ValueError("keys must be distinct")
        sizes, bits = [], []
        while len(high):
            size = -(-2 * len(high) // 64) * 64
            at = _slots(high, low, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at]
            high, low = high[left], low[left]
        return cls(sizes, np.concatenate(bits) if bits else np.empty(0, np.uint64))

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out, todo, start = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = _slots(high[todo], low[todo], level, size)
            word = self.bits[start + (at >> _SIX).astype(np.int64)]
            place = at & _LAST
            here = (word >> place) & _ONE == _ONE
            lower = np.bitwise_count(word & ((_ONE << place) - _ONE)).astype(np.int64)
            out[todo[here]] = (self.before[start + (at >> _SIX).astype(np.int64)] + lower)[here]
            todo = todo[~here]
            start += size // 64
        return out


class CountIndex:
    """Counts of keys: a perfect hash, and at each key's number its fingerprint (the low half) and its count."""

    def __init__(self, numbers: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray):
        self.perfect, self.fingerprints, self.counts = numbers, fingerprints, counts

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> CountIndex:
        perfect = PerfectHash.of(high, low)
        order = np.argsort(perfect.numbers(high, low))
        # Counts above 32 bits stay at the top value.
        return cls(perfect, low[order], np.minimum(counts[order], (1 << 32) - 1).astype(np.uint32))

    def of_keys(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The count of each key, 0 for keys that are not in the index."""
        if not len(self.counts):
            return np.zeros(len(high), np.int64)
        at = self.perfect.numbers(high, low)
        known = (at >= 0) & (self.fingerprints[at] == low)
        return np.where(known, self.counts[at], 0).astype(np.int64)

    def row(self) -> dict:
        return {
            "n": len(self.counts), "sizes": np.array(self.perfect.sizes, np.int64).tobytes(), "bits": self.perfect.bits.tobytes(),
            "fingerprints": self.fingerprints.tobytes(), "counts": self.counts.tobytes(),
        }

    @classmethod
    def read(cls, row: dict) -> CountIndex:
        perfect = PerfectHash(np.frombuffer(row["sizes"], np.int64).tolist(), np.frombuffer(row["bits"], np.uint64))
        return cls(perfect, np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.uint32))


SHARD_ROW = "n bigint, sizes binary, bits binary, fingerprints binary, counts binary"
