"""Sampled segmentations of a SentencePiece vocabulary: forward filtering, backward sampling over the piece lattice.

A segmentation is drawn with a probability in proportion to the product of its pieces' weights. The weight of a piece
falls with its rank in the vocabulary, as (rank + SHIFT) to the power of -theta: a larger theta prefers frequent pieces.
Forward filtering sums the weights of all segmentations of every prefix of a stretch; backward sampling then draws
pieces from its end. Draws are hashes of the seed, the row's key, and the place, so they do not depend on how rows are
dealt out. Pieces never cross a change between letters, digits, marks and line ends, nor begin with a space elsewhere than
in front; so texts fall into stretches, each different one is filtered once, and all stretches of a batch are sampled
together, step by step.

Decoding is lossless: spaces are written as the vocabulary's sign for them, one is put before the text and taken off
again, and characters that are no piece, among them that sign itself where the text holds it, are coded as bytes.

Defined cases: a null or empty text has no piece and decodes to the empty text; a null key is a key like any other; equal
rows are segmented equally.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from saldo.llm.packing import plain_runs
from saldo.llm.shingles import column_bytes, hash_runs, mix

VOCABULARY = "piece_bpe_32k.model"
THETA = 1.0
SHIFT = 10
CHUNK = (1 << 19) - 2
_SIGN = "▁"


class Pieces:
    """The pieces of a vocabulary by the hash of their bytes, a space standing for the vocabulary's sign for it."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_from = model.piece_to_id("<0x00>")
        self.texts: list[bytes] = []
        ids = []
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.texts.append(bytes([i - self.bytes_from]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.texts.append(b"")
            else:
                self.texts.append(model.id_to_piece(i).replace(_SIGN, " ").encode())
                ids.append(i)
        self.weights = {self.texts[i].decode(): ((rank + SHIFT) ** -theta, i) for rank, i in enumerate(ids)}
        data = np.frombuffer(b"".join(self.texts[i] for i in ids), dtype=np.uint8)
        sizes = np.array([len(self.texts[i]) for i in ids])
        past = np.cumsum(sizes)
        hashes = hash_runs(data, past - sizes, past)
        order = np.argsort(hashes)
        self._hashes, self._sizes = hashes[order], sorted(set(sizes.tolist()))
        self._ids = np.array(ids, dtype=np.int32)[order]
        self._weights = (np.arange(len(ids)) + SHIFT)[order] ** -theta
        self._maybe = np.zeros(1 << 20, dtype=bool)
        self._maybe[hashes >> np.uint64(44)] = True
        self._longest = self._sizes[-1]
        kinds = ("[A-Za-zÀ-ÖØ-öø-ÿ]+", "[0-9]+", r"[!-/:-@\[-`{-~]+")
        plain = re.compile("|".join(rf" ?{x}" for x in kinds) + "|\n| +")
        other = re.compile(r"[^ -~\nÀ-ÖØ-öø-ÿ]")
        #: Whether every piece of plain characters lies within one kind of run.
        self.keeps_runs = all(plain.fullmatch(x) or other.search(x) for x in self.weights)

    def _edges(self, data: np.ndarray, starts: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, ...]:
        """First byte, size, weight and id of the pieces within the runs data[start:past], which cover all of data."""
        room = np.repeat(past, past - starts) - np.arange(len(data))
        found = []
        for size in self._sizes:
            at = np.flatnonzero(room >= size)
            if not len(at):
                break
            hashes = hash_runs(data, at, at + size)
            maybe = self._maybe[hashes >> np.uint64(44)]
            at, hashes = at[maybe], hashes[maybe]
            place = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
            same = self._hashes[place] == hashes
            found.append((at[same], np.full(int(same.sum()), size), self._weights[place[same]], self._ids[place[same]]))
        # Characters that are no piece: one edge per byte; together as good as a very rare piece.
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        size = np.diff(np.append(lead, len(data)))
        single = np.zeros(len(data), dtype=bool)
        for at, sizes, _, _ in found:
            whole = np.zeros(len(data), dtype=np.int64)
            whole[lead] = size
            single[at[whole[at] == sizes]] = True
        alone = np.flatnonzero(np.repeat(~single[lead], size))
        weight = np.where((data[alone] & 0xC0) != 0x80, 1e-6, 1.0)
        found.append((alone, np.ones(len(alone), dtype=np.int64), weight, self.bytes_from + data[alone].astype(np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def lattices(self, data: np.ndarray, starts: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, ...]:
        """Forward filtering of all runs together.

        Returns for each run the number of its last position, and per edge, those that end at one position together: that
        position plus the sum of probabilities up to the edge, the position it begins at (-1: the run's start), its id.
        """
        at, size, weight, ids = self._edges(data, starts, past)
        run = np.repeat(np.arange(len(starts)), past - starts)
        # Position k of run r, counted from its start 0, is number starts[r] + r + k.
        first = starts + np.arange(len(starts))
        begin = at + run[at]
        end = begin + size
        depth = end - first[run[at]]
        order = np.argsort((depth << 40) | end, kind="stable")
        begin, end, weight, ids, depth = begin[order], end[order], weight[order], ids[order], depth[order]
        alpha = np.zeros(len(data) + len(starts), dtype=np.float64)
        alpha[first] = 1.0
        group = np.flatnonzero(np.diff(end, prepend=-1))
        levels = np.append(np.flatnonzero(np.diff(depth, prepend=-1)), len(depth))
        bounds = np.searchsorted(group, levels)
        parts = np.empty(len(end), dtype=np.float64)
        for k in range(len(levels) - 1):
            a, b = levels[k], levels[k + 1]
            parts[a:b] = alpha[begin[a:b]] * weight[a:b]
            here = group[bounds[k] : bounds[k + 1]]
            total = np.add.reduceat(parts[a:b], here - a)
            alpha[end[here]] = total
            small = end[here][total < 1e-150]
            for place in small.tolist():  # far into a long run: only ratios within the reach of a piece count
                low = max(place - self._longest, int(first[np.searchsorted(first, place, side="right") - 1]))
                alpha[low : place + 1] *= 1e150
                parts[a:b][end[a:b] == place] *= 1e150
        number = np.full(len(alpha), -1)
        number[end[group]] = np.arange(len(group))
        counts = np.diff(np.append(group, len(end)))
        state = np.repeat(np.arange(len(group)), counts)
        total = np.add.reduceat(parts, group)
        parts /= total[state]
        sums = np.cumsum(parts)
        sums -= (sums[group] - parts[group])[state]
        sums[np.append(group[1:], len(end)) - 1] = 1.0
        return number[past + np.arange(len(starts))], sums + state, number[begin], ids


@lru_cache(maxsize=2)
def pieces(path: str, theta: float) -> Pieces:
    """One per Python worker, kept between tasks."""
    return Pieces(path, theta)


def decoded(ids: np.ndarray, tables: Pieces) -> str:
    return b"".join(map(tables.texts.__getitem__, ids.tolist())).decode()[1:]


def _draws(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the key and the step alone."""
    return (mix(key + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(last: np.ndarray, sums: np.ndarray, before: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of all stretches together: their ids, and how many each has. last: their last positions."""
    taken = np.zeros(len(last), dtype=np.int64)
    occurrence, here, steps = np.arange(len(last)), last, []
    while len(occurrence):
        edge = np.searchsorted(sums, here + _draws(keys[occurrence], len(steps)), side="right")
        steps.append((occurrence, ids[edge]))
        taken[occurrence] += 1
        here = before[edge]
        more = here >= 0
        occurrence, here = occurrence[more], here[more]
    ends = np.cumsum(taken)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    for step, (occurrence, found) in enumerate(steps):
        out[ends[occurrence] - 1 - step] = found
    return out, taken


def _stretches(data: np.ndarray, begins: np.ndarray, keeps_runs: bool) -> np.ndarray:
    """First bytes of the stretches of texts: plain runs, or in other texts what begins at each run of spaces."""
    starts, plain = plain_runs(data, begins)
    plain &= keeps_runs
    if plain.all():
        return starts
    of = np.searchsorted(begins, starts, side="right") - 1
    space = data == 0x20
    space[1:] &= ~space[:-1]
    space[begins] = True
    spaces = np.flatnonzero(space)
    return np.union1d(starts[plain[of]], spaces[~plain[np.searchsorted(begins, spaces, side="right") - 1]])


def segment(keys: np.ndarray, texts: pa.Array, tables: Pieces, seed: int) -> Iterator[np.ndarray]:
    """The sampled ids of every text (not null), keys being their rows' keys (uint64)."""
    filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    texts = pc.if_else(pa.array(filled), pc.binary_join_element_wise(" ", texts, ""), texts)
    raw, ends = column_bytes(texts)
    keys = mix(keys ^ mix(np.array([seed], dtype=np.uint64)))
    i, rows = 0, len(ends) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
        own = np.flatnonzero(ends[i + 1 : j + 1] > ends[i:j])
        found = iter(())
        if len(own):
            data, begins = raw[ends[i] : ends[j]], ends[i:j][own] - ends[i]
            starts = _stretches(data, begins, tables.keeps_runs)
            past = np.append(starts[1:], len(data))
            _, first, which = np.unique(hash_runs(data, starts, past), return_index=True, return_inverse=True)
            # The different stretches, one after the other.
            sizes = (past - starts)[first]
            to = np.cumsum(sizes)
            bytes_at = np.arange(int(to[-1])) + np.repeat(starts[first] - (to - sizes), sizes)
            last, sums, before, ids = tables.lattices(data[bytes_at], to - sizes, to)
            # The place of a stretch in its text is part of its draws.
            owner = np.searchsorted(begins, starts, side="right") - 1
            firsts = np.searchsorted(starts, begins)
            place = (np.arange(len(starts)) - firsts[owner]).astype(np.uint64)
            draws = mix(keys[i:j][own][owner] + place * np.uint64(0xD1342543DE82EF95))
            codes, taken = sample(last[which], sums, before, ids, draws)
            cuts = np.concatenate(([0], np.cumsum(taken)))[np.append(firsts, len(starts))].tolist()
            found = (codes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        for k in range(i, j):
            yield next(found) if ends[k + 1] > ends[k] else np.empty(0, dtype=np.int32)
        i = j


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


def _keys(column: pa.Array) -> np.ndarray:
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return mix(pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) ^ np.where(
        known, np.uint64(0), np.uint64(0xA0761D6478BD642F)
    )


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 0, theta: float = THETA, path: str | None = None) -> DataFrame:
    """(key, ids): the ids of a sampled segmentation of each text."""
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(path, theta)
        for batch in batches:
            ids = list(segment(_keys(batch.column(0)), pc.fill_null(batch.column(1), ""), tables, seed))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text): the texts of ids."""
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(path, THETA)
        for batch in batches:
            texts = [decoded(np.array(x or [], dtype=np.int32), tables) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


DIGESTS = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string"


def sampled(docs: DataFrame, seed: int = 0, theta: float = THETA, path: str | None = None) -> DataFrame:
    """Per document the number and the CRC of its sampled ids, and the digest of the text they decode to."""
    path = _path(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pieces(path, theta)
        for batch in batches:
            out = []
            rows = zip(batch.column(0).to_pylist(), segment(_keys(batch.column(0)), pc.fill_null(batch.column(1), ""), tables, seed), strict=True)
            for key, ids in rows:
                text = decoded(ids, tables)
                out.append((key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sha256(text.encode()).hexdigest()))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
