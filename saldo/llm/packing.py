"""Tokenizing documents and packing them into sequences: bulk-synchronous best-fit.

Each document's tokens, closed by an end mark, form one piece, or several if they are more than a sequence holds: then
all but the first are of full length. Pieces are packed whole.

Pieces of more than half a sequence open one each. The others go by bands of length, the long ones first; a band holds what
fits equally often into an empty sequence (short lengths are put together, down to half the longest). A superstep range-sorts
the band's open pieces and all gaps that may hold one, by size, and sweeps each range from its large end: a gap goes onto a
stack, a piece takes the gap on top, which is its successor, the smallest that holds it and is still free; of pieces that
want the same gap the first in rank gets it. What a range leaves over is settled between ranges: pieces go on to the gaps of
the ranges above, the nearest first, and only counts per range are needed to say which piece takes which. Gaps are updated and
written, and the next superstep begins, until no piece finds a gap; then pieces next to each other in rank open sequences
together, as many to each as fit. Each piece and each gap is a row; ranges split equal sizes by key, so no size is too common.

This needs as many sequences as best-fit decreasing does one piece after the other, in all cases tried (see the tests). The
number of supersteps follows the bands, not the documents. What reaches the driver is one counter per length and per range.

Defined cases: a null text counts as empty and yields one piece holding only the end mark; no row gives no sequence;
equal rows are packed separately; null ids are kept.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saldo.llm.shingles import column_bytes, hash_runs
from saldo.session import new_folder

CAPACITY = 1024
END = 2
#: Different runs whose ids a worker keeps, about; some 50 MB.
MEMO = 1_000_000
VOCABULARY = "byte_bpe_50k.json"


#: Classes of bytes. In texts of only these, the vocabulary's splitting rule keeps runs of letters, digits or marks
#: apart, each with at most one space before it, and line ends; so every different run need be coded only once. The
#: apostrophe, which may start a contraction, and all characters but Latin-1 letters beyond ASCII are left out.
_OTHER, _SPACE, _LINE, _LETTER, _DIGIT, _MARK, _LEAD = range(7)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[0x20], _CLASS[0x0A], _CLASS[0xC3] = _SPACE, _LINE, _LEAD
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[x for x in range(0x21, 0x7F) if _CLASS[x] == _OTHER and x != 0x27]] = _MARK
#: Bytes after 0xC3 that make a letter: U+00C0 to U+00FF but for the signs of multiplication and division.
_SECOND = np.zeros(256, dtype=bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
#: Coded at once, in bytes.
CHUNK = (1 << 20) - 2


class _Memo:
    """Ids of runs in arrays, found by the hashes of the runs, as these differ within a chunk anyway.

    When it is full, the runs that no second chunk has asked for are dropped, and all if that leaves too many.
    """

    def __init__(self, tokenizer, most: int):
        self._tokenize, self._most = tokenizer.model.tokenize, most
        # The vocabulary writes every byte as a printable character: itself, or one from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self._signs = dict.fromkeys(plain) | {x: 256 + i for i, x in enumerate(x for x in range(256) if x not in plain)}
        self._signs = {x: x if y is None else y for x, y in self._signs.items()}
        self._space = chr(self._signs[0x20])
        self.forget()

    def _coded(self, run: str) -> list[int]:
        """run: the bytes of a plain run as Latin-1 characters."""
        if run.isascii() and run != "\n":
            signs = self._space + run[1:] if run[0] == " " else run
        else:
            signs = run.translate(self._signs)
        return [x.id for x in self._tokenize(signs)]

    def forget(self) -> None:
        self._hashes, self._numbers = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)  # by hash; of the entries
        self._bounds, self.pool = np.zeros(1, dtype=np.int64), np.empty(0, dtype="<u4")  # of the ids of each entry
        self._again = np.empty(0, dtype=bool)

    def _tidy(self) -> None:
        if len(self._numbers) <= self._most and len(self.pool) <= 8 * self._most:
            return
        kept = np.flatnonzero(self._again)
        sizes = np.diff(self._bounds)[kept]
        if 2 * len(kept) > self._most or sizes.sum() > 4 * self._most:
            self.forget()
            return
        self.pool = self.pool[_stretches(self._bounds[kept], sizes)]
        self._bounds = np.append(0, np.cumsum(sizes))
        stays = self._again[self._numbers]
        renumbered = np.cumsum(self._again, dtype=np.int32) - np.int32(1)
        self._hashes, self._numbers = self._hashes[stays], renumbered[self._numbers[stays]]
        self._again = np.zeros(len(kept), dtype=bool)

    def __call__(self, hashes: np.ndarray, first: np.ndarray, ends: np.ndarray, text: str) -> tuple[np.ndarray, ...]:
        """Where the ids of the runs text[first:end] begin in the pool, and how many they are; their hashes ascend and differ."""
        self._tidy()
        at = np.searchsorted(self._hashes, hashes)
        known = at < len(self._hashes)
        known[known] = self._hashes[at[known]] == hashes[known]
        numbers = np.empty(len(hashes), dtype=np.int32)
        numbers[known] = self._numbers[at[known]]
        self._again[numbers[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            coded = [self._coded(text[a:b]) for a, b in zip(first[new].tolist(), ends[new].tolist(), strict=True)]
            sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
            pool = np.fromiter(chain.from_iterable(coded), dtype="<u4", count=int(sizes.sum()))
            numbers[new] = np.arange(len(self._numbers), len(self._numbers) + len(new))
            self._bounds = np.concatenate((self._bounds, len(self.pool) + np.cumsum(sizes)))
            self.pool = np.concatenate((self.pool, pool))
            self._again = np.concatenate((self._again, np.zeros(len(new), dtype=bool)))
            self._hashes = np.insert(self._hashes, at[new], hashes[new])
            self._numbers = np.insert(self._numbers, at[new], numbers[new])
        return self._bounds[numbers], self._bounds[numbers + 1] - self._bounds[numbers]


def _stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of stretches that begin at and have so many, one after the other."""
    total = np.cumsum(sizes)
    return np.repeat(begins - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)


def plain_runs(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the runs of texts (uint8, one after the other from `begins`), and which texts have only plain runs."""
    kind = _CLASS[data]
    lead = np.flatnonzero(kind == _LEAD)
    kind[lead] = _OTHER
    lead = lead[lead + 1 < len(data)]
    lead = lead[_SECOND[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    first = np.zeros(len(data), dtype=bool)
    first[begins] = True
    after = np.full(len(data), _LINE, dtype=np.uint8)  # the class of the next byte, _LEAD past the end of a text
    after[:-1] = kind[1:]
    after[np.append(begins[1:], len(data)) - 1] = _LEAD
    odd = kind == _OTHER
    odd |= (kind == _SPACE) & ((after == _SPACE) | (after == _LINE) | (after == _LEAD))
    odd |= (kind == _LINE) & (after == _LINE)
    before = np.empty(len(data), dtype=np.uint8)
    before[1:] = kind[:-1]
    before[begins] = _LEAD
    starts = first | (kind <= _LINE) | ((kind != before) & (before != _SPACE))
    texts = np.searchsorted(begins, np.flatnonzero(odd), side="right") - 1
    plain = np.ones(len(begins), dtype=bool)
    plain[texts] = False
    return np.flatnonzero(starts), plain


class Ids:
    """Token ids of texts. Texts of plain runs are coded many at a time, each different run once; others whole."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._memo = _Memo(self._tokenizer, memo)

    def _many(self, data: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
        starts, plain = plain_runs(data, begins)
        bounds, raw = np.append(begins, len(data)), data.tobytes()
        if plain.any():
            ends = np.append(starts[1:], len(data))
            # Runs of other texts may cut characters.
            coded = np.repeat(plain, np.diff(np.searchsorted(starts, bounds)))
            starts, ends = starts[coded], ends[coded]
            places, sizes = self._runs(data, starts, ends, raw.decode("latin-1"))
            ids = self._memo.pool[_stretches(places, sizes)]
            cuts = np.append(0, np.cumsum(sizes))[np.searchsorted(starts, bounds)].tolist()
        bounds = bounds.tolist()
        for i, whole in enumerate((~plain).tolist()):
            yield self.whole(raw[bounds[i] : bounds[i + 1]].decode()) if whole else ids[cuts[i] : cuts[i + 1]]

    def _runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each run begin in the memo's pool, and how many they are."""
        found = pa.array(hash_runs(data, starts, ends)).dictionary_encode()
        which, hashes = found.indices.to_numpy(), found.dictionary.to_numpy()
        first = np.empty(len(hashes), dtype=np.int64)
        first[which] = np.arange(len(which))  # any run of the same hash
        order = np.argsort(hashes)
        places, sizes = np.empty_like(first), np.empty_like(first)
        places[order], sizes[order] = self._memo(hashes[order], starts[first[order]], ends[first[order]], text)
        return places[which], sizes[which]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of an Arrow string column; null counts as empty."""
        raw, ends = column_bytes(column)
        i, rows = 0, len(ends) - 1
        while i < rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
            filled = np.flatnonzero(ends[i + 1 : j + 1] > ends[i:j])
            found = iter(())
            if len(filled):
                found = self._many(raw[ends[i] : ends[j]], ends[i:j][filled] - ends[i])
            for k in range(i, j):
                yield next(found) if ends[k + 1] > ends[k] else np.empty(0, dtype="<u4")
            i = j


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    """One tokenizer per Python worker, kept with the runs it remembers between tasks, until a worker sweeps."""
    return Ids(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, id long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document, each with an id: the number of the task that made it, and its number there."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    mark = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = ids_of(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for key, coded in zip(batch.column(0).to_pylist(), ids(batch.column(1)), strict=True):
                total = len(coded) + 1
                length = (total - 1) % capacity + 1
                start = piece = 0
                while start < total:
                    crc = zlib.crc32(coded[start : start + length])
                    if start + length == total:
                        crc = zlib.crc32(mark, crc)
                    out.append((key, piece, start, length, crc, own))
                    own += 1
                    start, piece, length = start + length, piece + 1, capacity
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names
                )

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


@dataclass
class _Range:
    """What the sweep of one range leaves over."""

    part: int
    gaps: int
    pieces: int
    longest: int
    shortest: int


def let_go() -> None:
    """Gives back what a worker that tokenized before still holds: the tokenizer, and freed memory that its allocators keep."""
    if ids_of.cache_info().currsize:
        ids_of.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps one range of (size, kind, key), sorted from the large end, gaps before pieces of equal size."""
    let_go()
    part, stack, missed = TaskContext.get().partitionId(), [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, _SWEPT_KINDS, strict=True)], _SWEPT_NAMES)

    for batch in batches:
        rows = []
        for size, kind, key in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if kind == GAP:
                stack.append((key, size))
            elif stack:
                sequence, left = stack.pop()
                rows.append((MATCHED, part, None, key, size, sequence, left))
            else:
                rows.append((PIECE, part, missed, key, size, None, None))
                missed += 1
        if rows:
            yield batch_of(rows)
    for first in range(0, len(stack), 10_000):
        yield batch_of([(GAP, part, i, None, None, *stack[i]) for i in range(first, min(first + 10_000, len(stack)))])


GAP, PIECE, MATCHED = 0, 1, 2
_SWEPT = "what int, part int, at long, id long, length long, sequence_id long, room long"
_SWEPT_NAMES = [x.split()[0] for x in _SWEPT.split(", ")]
_SWEPT_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
#: Rows per range of a superstep, about, and ranges at least.
RANGE_ROWS = 50_000
RANGES = 4


def settle(ranges: list[_Range]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Which leftover pieces take which leftover gaps of the ranges above, and how many of each range do.

    (part of the pieces, first of them, past the last, part of the gaps, gap of the first): the pieces take gaps downwards.
    """
    moves, stack, done = [], [], {}
    for x in sorted(ranges, key=lambda x: x.part):
        taken = 0
        while taken < x.pieces and stack:
            part, free = stack[-1]
            n = min(free, x.pieces - taken)
            moves.append((x.part, taken, taken + n, part, free - 1))
            taken += n
            stack[-1] = (part, free - n)
            if free == n:
                stack.pop()
        done[x.part] = taken
        if x.gaps:
            stack.append((x.part, x.gaps))
    return moves, done


class _Packing:
    """The tables of a packing under way, below one shared folder."""

    def __init__(self, spark: SparkSession, capacity: int):
        self.spark, self.capacity = spark, capacity
        self.folder = new_folder(spark, "packing")
        self.step = 0
        #: Schema and folders of what was written by that name.
        self.made: dict[str, tuple[StructType, list[str]]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        folder = f"{self.folder}/{name}-{self.step:04}"
        df.write.parquet(folder)
        self.made.setdefault(name, (df.schema, []))[1].append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def every(self, name: str) -> list[DataFrame]:
        """What all supersteps have written by a name, as one table; none if there is nothing."""
        if name not in self.made:
            return []
        schema, folders = self.made[name]
        return [self.spark.read.schema(schema).parquet(*folders)]

    def placed(self) -> list[DataFrame]:
        """(id, sequence_id, offset) of all pieces placed so far: one table per way of finding a place, not per superstep."""
        beside = [x.where(F.col("what") == MATCHED) for x in self.every("swept")] + self.every("settled")
        beside = [x.select("id", "sequence_id", (F.lit(self.capacity) - F.col("room")).alias("offset")) for x in beside]
        return beside + [x.select("id", "sequence_id", "offset") for x in self.every("opened")]

    def swept(self, open_: DataFrame, gaps: DataFrame, rows: int) -> tuple[DataFrame, list[_Range]]:
        """The sweep of a superstep, and what its ranges leave over."""
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(min(RANGES, most), min(most, -(-rows // RANGE_ROWS)))
        both = gaps.select(F.col("room").alias("size"), F.lit(GAP).alias("kind"), F.col("sequence_id").alias("key")).unionByName(
            open_.select(F.col("length").alias("size"), F.lit(PIECE).alias("kind"), F.col("id").alias("key"))
        )
        order = [F.desc("size"), F.asc("kind"), F.asc("key")]
        ranged = both.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        found = self.written(ranged.mapInArrow(_sweep, _SWEPT), "swept")
        left = (
            found.groupBy("part")
            .agg(
                F.count_if(F.col("what") == GAP).alias("gaps"),
                F.count_if(F.col("what") == PIECE).alias("pieces"),
                F.coalesce(F.max(F.when(F.col("what") == PIECE, F.col("length"))), F.lit(0)).alias("longest"),
                F.coalesce(F.min(F.when(F.col("what") == PIECE, F.col("length"))), F.lit(0)).alias("shortest"),
            )
            .collect()
        )
        return found, [_Range(*x) for x in left]

    def matched(self, found: DataFrame, ranges: list[_Range], moves: list[tuple]) -> tuple[DataFrame, DataFrame]:
        """Pieces with their gaps, those settled between ranges included, and the gaps that stay as they are."""
        gaps = found.where(F.col("what") == GAP)
        pairs = found.where(F.col("what") == MATCHED).select("id", "length", "sequence_id", "room")
        if not moves:
            return pairs, gaps.select("sequence_id", "room")
        # At most two moves per range.
        moved = F.broadcast(self.spark.createDataFrame(moves, "part int, first long, past long, above int, top long"))
        wanting = found.where(F.col("what") == PIECE).select("part", "at", "id", "length")
        wanting = wanting.join(moved, "part").where("at >= first AND at < past")
        wanting = wanting.select("id", "length", F.col("above").alias("part"), (F.col("top") - (F.col("at") - F.col("first"))).alias("at"))
        settled = self.written(gaps.select("part", "at", "sequence_id", "room").join(wanting, ["part", "at"]), "settled")
        # The gaps of a range are taken from its last one on.
        free = {x.part: x.gaps for x in ranges}
        for _, first, past, above, _ in moves:
            free[above] -= past - first
        rest = gaps.where(F.col("at") < by_part(free)).select("sequence_id", "room")
        return pairs.unionByName(settled.select("id", "length", "sequence_id", "room")), rest


def by_part(numbers: dict[int, int]) -> Column:
    """The number of a row's part; null without one. No table is made and joined for so few."""
    listed = ",".join(str(numbers.get(x, "")) for x in range(max(numbers) + 1))
    return F.get(F.split(F.lit(listed), ",").try_cast("array<long>"), F.col("part"))


def superstep(state: _Packing, open_: DataFrame, gaps: DataFrame, low: int, rows: int) -> tuple[DataFrame, DataFrame, int, int]:
    """One superstep for the open pieces of a band, all longer than low; rows: how many of these and gaps there are.

    Gives the pieces still open and all gaps, and how many there are of each.
    """
    state.step += 1
    found, ranges = state.swept(open_, gaps.where(F.col("room") > low), rows)
    moves, done = settle(ranges)
    pairs, rest = state.matched(found, ranges, moves)
    behind = pairs.select("sequence_id", (F.col("room") - F.col("length")).alias("room")).where("room > 0")
    gaps = state.written(gaps.where(F.col("room") <= low).unionByName(rest).unionByName(behind), "gaps")
    seen = gaps.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("room"), F.lit(0)).alias("room")).first()

    # Those that found no gap, numbered by rank.
    missing, taken, shift, left = [x for x in ranges if x.pieces > done[x.part]], {}, {}, 0
    for x in sorted(missing, key=lambda x: x.part):
        taken[x.part], shift[x.part] = done[x.part], left - done[x.part]
        left += x.pieces - done[x.part]
    if not left:
        return open_, gaps, 0, seen["n"]
    missed = found.where((F.col("what") == PIECE) & (F.col("at") >= by_part(taken)))
    missed = missed.select("id", "length", (F.col("at") + by_part(shift)).alias("rank"))
    if seen["room"] >= min(x.shortest for x in missing):  # a gap may hold one more
        return missed.select("id", "length"), gaps, left, seen["n"]

    # Neighbours in rank open sequences together, as many as fit of the longest, which comes first.
    each = state.capacity // max(x.longest for x in missing)
    whole = left // each * each or left
    opening = missed.where(F.col("rank") < whole).withColumn("group", F.floor(F.col("rank") / each).cast("long"))
    so_far = Window.partitionBy("group").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.sum("length").over(so_far)
    last = (F.col("rank") % each == each - 1) | (F.col("rank") == whole - 1)
    opened = state.written(
        opening.select(
            "id", "length", F.first("id").over(so_far).alias("sequence_id"), (filled - F.col("length")).alias("offset"),
            F.when(last, F.lit(state.capacity) - filled).alias("room"),
        ),
        "opened",
    )
    new = opened.where("room > 0").select("sequence_id", "room")
    return missed.where(F.col("rank") >= whole).select("id", "length"), gaps.unionByName(new), left - whole, seen["n"] + whole // each


def bands(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, int]]:
    """(low, high) of the bands of lengths up to half the capacity, the long ones first; pieces are longer than low."""
    lengths = sorted((x for x in counts if 2 * x <= capacity), reverse=True)
    while lengths:
        high = lengths[0]
        times = capacity // high
        low = capacity // (times + 1) if times < 16 else high // 2
        yield low, high
        lengths = [x for x in lengths if x <= low]


def pack(spark: SparkSession, made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (length, id and any other columns) with sequence_id and offset instead of id."""
    state = _Packing(spark, capacity)
    made = state.written(made, "pieces")
    counts = {row["length"]: row["count"] for row in made.groupBy("length").count().collect()}  # up to the capacity
    alone = F.col("length") * 2 > capacity
    gaps = made.where(alone & (F.col("length") < capacity))
    gaps = gaps.select(F.col("id").alias("sequence_id"), (F.lit(capacity) - F.col("length")).alias("room"))
    n_gaps = sum(n for length, n in counts.items() if capacity < 2 * length < 2 * capacity)
    for low, high in bands(counts, capacity):
        open_ = made.where((F.col("length") > low) & (F.col("length") <= high)).select("id", "length")
        left = sum(n for length, n in counts.items() if low < length <= high)
        while left:
            open_, gaps, left, n_gaps = superstep(state, open_, gaps, low, left + n_gaps)
    own = made.where(alone).withColumn("sequence_id", F.col("id")).withColumn("offset", F.lit(0).cast("long"))
    if not (placed := state.placed()):
        return own.drop("id")
    placed = reduce(DataFrame.unionByName, placed)
    return own.unionByName(made.where(~alone).join(placed, "id")).drop("id")


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents, each with its sequence and offset."""
    made = pieces(docs, vocabulary, capacity, end)
    return pack(docs.sparkSession, made, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
