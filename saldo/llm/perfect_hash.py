"""Minimal perfect hashing of 64-bit keys by levels of bits.

At each level the keys that are left are dealt over twice as many bits; those alone on theirs set it, the others go to the
next level. A key's number is the count of set bits before its own, so n keys are numbered 0 to n - 1 and looking one up
takes a constant expected number of steps. Keys that are not of the set get any number or none; whoever stores something per
number stores a fingerprint with it.
"""

from __future__ import annotations

import numpy as np

from saldo.llm.shingles import mix

#: Bits per key and level.
ROOM = 2
_STEP = 0x9E3779B97F4A7C15
_U = np.uint64


def _places(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys + _U((level + 1) * _STEP % 2**64)) % _U(bits)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits per key, independent of its places."""
    return (mix(~keys) >> _U(32)).astype(np.uint32)


class PerfectHash:
    def __init__(self, words: np.ndarray, bits: np.ndarray):
        """words: the levels' bits, 64 to a word; bits: how many each level has, whole words."""
        self.words, self.bits = words.astype(_U), bits.astype(np.int64)
        self.first = np.append(0, np.cumsum(self.bits >> 6))
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: different ones, as uint64."""
        rest, words, bits = keys, [], []
        while len(rest):
            size = -(-len(rest) * ROOM // 64) * 64
            places = _places(rest, len(bits), size)
            counts = np.bincount(places.astype(np.int64), minlength=size)
            words.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            bits.append(size)
            rest = rest[counts[places.astype(np.int64)] != 1]
        return cls(np.concatenate(words) if words else np.empty(0, dtype=_U), np.array(bits, dtype=np.int64))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; -1 for some that are not of the set."""
        found = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.bits.tolist()):
            if not len(open_):
                break
            places = _places(keys[open_], level, size).astype(np.int64)
            word, bit = self.first[level] + (places >> 6), (places & 63).astype(_U)
            value = self.words[word]
            hit = (value >> bit) & _U(1) == 1
            below = np.bitwise_count(value & ((_U(1) << bit) - _U(1)))
            found[open_[hit]] = (self.before[word] + below)[hit]
            open_ = open_[~hit]
        return found
