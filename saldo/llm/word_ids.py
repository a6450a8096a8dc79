"""Token ids of texts in a vocabulary that lower-cases, drops white space and marks the ends of words.

Texts are cut where the vocabulary's own rule always cuts: at white space, and within a stretch of plain characters (ASCII
letters, digits and marks but the apostrophe, which may start a contraction, and Latin-1 letters) between runs of letters or
marks and after every digit. Each different run is coded once per batch of text; a stretch with any other character is coded
whole. The ids are those of the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from saldo.llm import words as W
from saldo.llm.shingles import column_bytes

VOCABULARY = "word_bpe_49k.json"
CHUNK = 1 << 21
#: Runs whose ids a worker keeps in each of two generations.
MEMO = 150_000

_OTHER, _SPACE, _LETTER, _DIGIT, _MARK, _LEAD = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _SPACE
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[x for x in range(0x21, 0x7F) if _CLASS[x] == _OTHER and x != 0x27]] = _MARK
_CLASS[0xC3] = _LEAD
#: Bytes after 0xC3 that make a letter, and what they are in lower case: U+00C0 to U+00DE are 32 above.
_SECOND = np.zeros(256, dtype=bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SECOND_LOWER = np.arange(256, dtype=np.uint8)
_SECOND_LOWER[0x80:0x9F] += 0x20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Whether a run is of plain characters only, so that the vocabulary takes it as one word.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+").fullmatch


def runs(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all runs one after the other, their bounds, and per text the number of its first run.

    data: the bytes of filled texts, one after the other from `begins`. Plain letters come out in lower case.
    """
    kind = _CLASS[data]
    lead = np.flatnonzero(kind == _LEAD)
    kind[lead] = _OTHER
    lead = lead[lead + 1 < len(data)]
    lead = lead[_SECOND[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    inside = kind != _SPACE
    before = np.full(len(data), _SPACE, dtype=np.uint8)
    before[1:] = kind[:-1]
    before[begins] = _SPACE
    stretch = inside & (before == _SPACE)
    number = np.cumsum(stretch)
    odd = np.zeros(int(number[-1]) + 1 if len(number) else 1, dtype=bool)
    odd[number[kind == _OTHER]] = True
    odd = odd[number]
    lowered = np.where(odd, data, _LOWER[data])
    second = lead[~odd[lead]] + 1
    lowered[second] = _SECOND_LOWER[lowered[second]]
    starts = np.flatnonzero(stretch | (inside & ~odd & ((kind != before) | (kind == _DIGIT))))
    kept = lowered[inside]
    bounds = np.append(np.cumsum(inside)[starts] - 1, len(kept))
    return kept, bounds, np.searchsorted(starts, begins)


class WordIds:
    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenize = self._tokenizer.model.tokenize
        self.width = 2 if self._tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._kind, self._code = np.dtype(f"<u{self.width}"), "HI"[self.width == 4]
        self._memo: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._most = memo
        # The vocabulary writes every byte as a printable character: itself, or one from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self._signs = {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in plain)}

    def _coded(self, run: bytes) -> bytes:
        if _PLAIN(run):
            found = self._tokenize(run.decode() if run.isalpha() else run.decode("latin-1").translate(self._signs))
            return array(self._code, [x.id for x in found]).tobytes()
        return array(self._code, self._tokenizer.encode(run.decode(), add_special_tokens=False).ids).tobytes()

    def _of(self, run: bytes) -> bytes:
        found = self._memo.get(run)
        if found is None:
            found = self._older.get(run) or self._coded(run)
            self._memo[run] = found
        return found

    def _tidy(self) -> None:
        if len(self._memo) > self._most:
            self._older, self._memo = self._memo, {}

    def forget(self) -> None:
        """Gives the memory of remembered runs back; workers live on between tasks."""
        self._memo, self._older = {}, {}

    def _many(self, data: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
        kept, bounds, first = runs(data, begins)
        found = W.encoded(kept, bounds)
        self._tidy()
        coded = [self._of(x) for x in found.dictionary.to_pylist()]
        which = found.indices.to_numpy()
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // self.width
        pool, places = np.frombuffer(b"".join(coded), dtype=self._kind), np.cumsum(sizes) - sizes
        sizes = sizes[which]
        total = np.cumsum(sizes)
        ids = pool[np.repeat(places[which] - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]
        cuts = np.append(0, total)[np.append(first, len(bounds) - 1)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield ids[a:b]

    def _long(self, data: np.ndarray) -> np.ndarray:
        """A text longer than a chunk, cut at white space."""
        parts, at, first = [], 0, np.zeros(1, dtype=np.int64)
        while at < len(data):
            end = min(at + CHUNK, len(data))
            while end < len(data) and _CLASS[data[end]] != _SPACE:
                gaps = np.flatnonzero(_CLASS[data[end : end + CHUNK]] == _SPACE)
                end = end + int(gaps[0]) if len(gaps) else min(end + CHUNK, len(data))
            parts.extend(self._many(data[at:end], first))
            at = end
        return np.concatenate(parts)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of an Arrow string column; null counts as empty."""
        raw, ends = column_bytes(column)
        i, rows = 0, len(ends) - 1
        while i < rows:
            j = int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1
            if j <= i:
                yield self._long(raw[ends[i] : ends[i + 1]])
                i += 1
                continue
            filled = np.flatnonzero(ends[i + 1 : j + 1] > ends[i:j])
            found = iter(())
            if len(filled):
                found = self._many(raw[ends[i] : ends[j]], ends[i:j][filled] - ends[i])
            for k in range(i, j):
                yield next(found) if ends[k + 1] > ends[k] else np.empty(0, dtype=self._kind)
            i = j


@lru_cache(maxsize=1)
def ids_of(path: str) -> WordIds:
    """One tokenizer per Python worker, kept between tasks."""
    return WordIds(path)
