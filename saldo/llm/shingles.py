"""Vectorised hashing of word shingles over Arrow string columns.

A word is a run of bytes other than space and the ASCII controls tab to carriage return. The hash of a word is the
sum of a fixed random value per byte times an odd base to the power of the byte's place, in 64 bits; the hash of a
shingle mixes the hashes of its words, so the kind and length of the white space between them does not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text hashed at once; bounds the temporary arrays at about 40 times as much.
CHUNK = 1 << 18

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _random.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256)
_lower[ord("A") : ord("Z") + 1] += 32
_BYTE_LOWER = _BYTE[_lower]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def _hash_words(data: np.ndarray, begins: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of data (uint8); a word also ends where a text begins."""
    n = len(data)
    inside = ~SPACE[data]
    after = np.zeros(n + 1, dtype=bool)  # whether the byte before belongs to the same word
    after[1:] = inside
    after[begins] = False
    starts = np.flatnonzero(inside & ~after[:n])
    after[0] = False
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & after[1:n])
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every run of bytes data[start:end]."""
    n = len(data)
    power, inverse = _power_tables(n + 1)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


_ZERO = np.zeros(1, dtype=np.int64)


def word_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of every word of one text (uint8), in order; long texts go piece by piece, cut at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word longer than a piece
                while end < len(data) and not SPACE[data[end : end + CHUNK]].any():
                    end = min(end + CHUNK, len(data))
                rest = np.flatnonzero(SPACE[data[end : end + CHUNK]])
                end += int(rest[0]) if len(rest) else 0
        parts.append(_hash_words(data[at:end], _ZERO, lower)[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of every run of `size` words, in order; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _PLACE[i]
    return mix(total + np.uint64(width))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the offsets of its texts, without copies; null as empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        raise TypeError(f"expected a string column, got {column.type}")
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw, ends


def shingles(column: pa.Array, lower: bool = False, size: int = WORDS) -> Iterator[np.ndarray]:
    """The shingle hashes of every text of an Arrow string column, in order of its words; short texts many at a time."""
    raw, ends = column_bytes(column)
    i, rows = 0, len(ends) - 1
    while i < rows:
        j = int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1
        if j <= i:
            yield shingle_hashes(word_hashes(raw[ends[i] : ends[i + 1]], lower), size)
            i += 1
            continue
        part, begins = raw[ends[i] : ends[j]], ends[i:j] - ends[i]
        words, starts = _hash_words(part, begins[begins < len(part)], lower)
        bounds = np.searchsorted(starts, np.append(begins, len(part)))
        if len(words) >= size:
            hashes = np.zeros(len(words) - size + 1, dtype=np.uint64)
            for k in range(size):
                hashes += words[k : len(words) - size + 1 + k] * _PLACE[k]
            hashes = mix(hashes + np.uint64(size))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield hashes[a : b - size + 1] if b - a >= size else shingle_hashes(words[a:b], size)
        i = j


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    if len(hashes) < 2:
        return hashes
    hashes = np.sort(hashes)
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def shingle_sets(column: pa.Array, lower: bool = False, size: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every text, ascending."""
    return map(distinct, shingles(column, lower, size))


def text_column(text: str) -> pa.Array:
    return pa.array([text], pa.large_string())
