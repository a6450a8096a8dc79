"""Words of Arrow string columns as Arrow dictionaries: runs of ASCII letters and digits and of all else beyond ASCII.

Only A to Z are lower-cased. Texts are taken many at a time; a text longer than CHUNK goes in pieces cut between words, so
the temporary arrays stay bounded by CHUNK and by the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from saldo.llm.shingles import column_bytes

#: Bytes of text taken at once.
CHUNK = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _back(data: np.ndarray, end: int, words: int) -> int:
    """Where the last `words` words of data[:end] begin."""
    step = 4096
    while True:
        start = max(0, end - step)
        inside = _INSIDE[data[start:end]]
        first = np.flatnonzero(inside & ~np.append(start > 0, inside[:-1]))  # a word that may begin earlier is left
        if len(first) >= words:
            return start + int(first[-words])
        if start == 0:
            return 0
        step *= 4


def texts(column: pa.Array, back: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, where each row's text begins, words already seen) of all filled texts of a column, piece by piece.

    A piece of a long text but its first repeats the `back` words before it, as long as there are so many.
    """
    raw, ends = column_bytes(column)
    i, n = 0, len(ends) - 1
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1
        if j > i:
            filled = np.flatnonzero(ends[i + 1 : j + 1] > ends[i:j])
            if len(filled):
                yield filled + i, _LOWER[raw[ends[i] : ends[j]]], ends[i:j][filled] - ends[i], 0
            i = j
            continue
        text, at, seen = raw[ends[i] : ends[i + 1]], 0, 0
        while at < len(text):
            end = min(at + CHUNK, len(text))
            while end < len(text) and _INSIDE[text[end]]:
                outside = np.flatnonzero(~_INSIDE[text[end : end + CHUNK]])
                end = end + int(outside[0]) if len(outside) else min(end + CHUNK, len(text))
            start = _back(text, at, back) if back and at else at
            if start < at:
                inside = _INSIDE[text[start:at]]
                seen = int(np.count_nonzero(inside & ~np.append([False], inside[:-1])))
            yield np.array([i]), _LOWER[text[start:end]], np.zeros(1, dtype=np.int64), seen
            at = end
        i += 1


def cut(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words one after the other, their bounds in these, and per text the number of its first word."""
    inside = _INSIDE[data]
    before = np.empty(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    first = np.searchsorted(starts, begins)
    kept = data[inside]
    # A word ends where the next one starts: there is nothing between the words any more.
    place = np.cumsum(inside)
    bounds = np.append(place[starts] - 1, len(kept))
    return kept, bounds, first


def encoded(kept: np.ndarray, bounds: np.ndarray) -> pa.DictionaryArray:
    """The words as an Arrow dictionary of different words and every word's number in it."""
    buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))]
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers).dictionary_encode()


def slices(array: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a binary column."""
    if not len(array):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = array.buffers()
    kind = np.int64 if pa.types.is_large_binary(array.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8), bounds
