"""Token ids as binary files with keyed access through a minimal perfect hash index.

A folder of token files holds, in ascending order of doc_id (null ids first):

  ids-<shard>.bin     the ids of the shard's documents, each closed by an end mark, as raw little-endian unsigned numbers
                      of 2 bytes, or 4 where the vocabulary is larger
  ends-<shard>.bin    per document the ids of the shard up to its end, as little-endian unsigned 64-bit numbers
  index-<bucket>.npz  a minimal perfect hash of the bucket's keys; at each key's number a fingerprint of the key, the shard,
                      the document's number there, and how many documents have this key
  manifest/           Parquet, one row per shard: its documents and ids and those before it, and the sizes above

A key is looked up in constant time: its hash names the bucket, the perfect hash the number, the fingerprint tells whether
the key is there at all (a strange key passes once in 2**32), and shard and number lead to the ids. Documents of equal
doc_id lie one after the other, if need be over several shards; the index holds the first. Null ids are the first documents
of all, and need no index.

Writing: ranges of doc_id are cut at quantiles, where an id so frequent that several cuts fall on it is spread over all their
shards; each range is sorted and streamed to its files by one task; the index is built by bucket. Files are written under a
name of their own and moved to their place when whole, so a task that runs twice leaves the same files. Reading: keys are
dealt by bucket to find their places, places by shard to read the payload in order. Only counts per shard pass the driver.

The folder must be one that Arrow's file systems reach from every executor (a path, or file:, hdfs:, s3:, gs: addresses).

Defined cases: a null text counts as empty and holds the end mark only; rows of equal doc_id are all kept, also equal rows;
an empty table gives an empty manifest; keys that are not there give no row. Other columns of the input are ignored.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm import word_ids
from saldo.llm.perfect_hash import PerfectHash, fingerprints
from saldo.session import new_folder

END = 2
#: Keys per bucket of the index, about.
BUCKET_KEYS = 500_000
#: Bytes of ids read, and handed on, at once.
BLOCK = 4 << 20

_SLOT = (("fingerprint", "<u4"), ("shard", "<u4"), ("number", "<u8"), ("copies", "<u8"))
MANIFEST = """shard int, documents long, ids long, documents_before long, ids_before long, nulls long, width int, buckets int"""


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there."""
    if folder.startswith("file:"):
        folder = re.sub(r"^file:/+", "/", folder)
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


class _File:
    """A file that comes to its place when it is whole."""

    def __init__(self, files: fs.FileSystem, path: str):
        self._files, self._path = files, path
        folder, _, name = path.rpartition("/")
        files.create_dir(folder, recursive=True)
        self._own = f"{folder}/_{name}-{uuid.uuid4().hex}"
        self._stream = files.open_output_stream(self._own)

    def write(self, data: bytes) -> None:
        self._stream.write(data)

    def close(self) -> None:
        self._stream.close()
        try:
            self._files.move(self._own, self._path)
        except OSError:  # some file systems do not replace; another run of this task has left the same file
            if self._files.get_file_info(self._path).type != fs.FileType.File:
                raise
            self._files.delete_file(self._own)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(buckets)).cast("int")


def _encoded(docs: DataFrame, vocabulary: str, end: int, cuts: list[int]) -> DataFrame:
    """(doc_id, part, row, ids): the ids of every document with the end mark, and the range that it belongs to."""
    bounds = np.array(cuts, dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids.ids_of(vocabulary)
        mark = end.to_bytes(coder.width, "little")
        for batch in batches:
            keys = batch.column(0)
            known = keys.is_valid().to_numpy(zero_copy_only=False)
            key, row = keys.fill_null(0).to_numpy(), batch.column(1).to_numpy()
            low, high = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            # Between cuts there is one range; a key on several cuts may go to any of theirs.
            part = np.where(known, low + np.where(high - low > 1, row % np.maximum(high - low, 1), 0), 0)
            cells, size, first = [], 0, 0
            for i, ids in enumerate(coder(batch.column(2))):
                cells.append(ids.tobytes() + mark)
                size += len(cells[-1])
                if size >= BLOCK or i + 1 == len(key):
                    columns = [x[first : i + 1] for x in (keys, pa.array(part, pa.int32()), pa.array(row))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.binary())], ["doc_id", "part", "row", "ids"])
                    cells, size, first = [], 0, i + 1
        coder.forget()

    rows = docs.select(
        F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.mapInArrow(encode, "doc_id long, part int, row long, ids binary")


ENTRIES = "doc_id long, shard int, number long, copies long, ids long"


def _write_shards(folder: str, width: int):
    """Writes the files of the parts of a task, sorted by part and doc_id; gives a row for every run of equal ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        shard = payload = ends = run = None
        number = total = 0
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)
            out.clear()
            return found

        schema = pa.schema([(n, pa.int32() if n == "shard" else pa.int64()) for n in names])
        for batch in batches:
            data = []
            for key, part, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != shard:
                    if shard is not None:
                        out.append(tuple(run))
                        payload.write(b"".join(data))
                        payload.close()
                        ends.close()
                    shard, number, total, run, data = part, 0, 0, None, []
                    payload = _File(files, f"{path}/ids-{shard:05}.bin")
                    ends = _File(files, f"{path}/ends-{shard:05}.bin")
                raw = cell.as_buffer()
                data.append(raw)
                total += raw.size // width
                ends.write(total.to_bytes(8, "little"))
                if run is not None and run[0] == key:
                    run[3] += 1
                    run[4] += raw.size // width
                else:
                    if run is not None:
                        out.append(tuple(run))
                    run = [key, shard, number, 1, raw.size // width]
                number += 1
            if shard is not None:
                payload.write(b"".join(data))
            if out:
                yield rows()
        if shard is not None:
            out.append(tuple(run))
            payload.close()
            ends.close()
            yield rows()

    return write


def _write_index(folder: str):
    """Writes the index of the buckets of a task; rows (bucket, doc_id, shard, number, copies) sorted."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            bucket, *columns = (x.to_numpy() for x in table.columns)
            keys, first = np.unique(columns[0], return_index=True)
            hashed = PerfectHash.of(keys.view(np.uint64))
            place = np.empty(len(keys), dtype=np.int64)
            place[hashed.numbers(keys.view(np.uint64))] = np.arange(len(keys))
            values = (
                fingerprints(keys.view(np.uint64)),
                columns[1][first],
                columns[2][first],
                np.add.reduceat(columns[3], first),
            )
            slots = {name: x[place].astype(kind) for (name, kind), x in zip(_SLOT, values, strict=True)}
            raw = io.BytesIO()
            np.savez(raw, words=hashed.words, bits=hashed.bits, **slots)
            file = _File(files, f"{path}/index-{bucket[0]:05}.npz")
            file.write(raw.getvalue())
            file.close()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([bucket[0]], pa.int32()), pa.array([len(keys)])], ["bucket", "keys"])

        for batch in batches:
            buckets = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(buckets)), np.flatnonzero(np.diff(buckets)) + 1):
                if not len(part):
                    continue
                if held and held[0].column(0)[0].as_py() != buckets[part[0]]:
                    yield close()
                held.append(batch.slice(int(part[0]), len(part)))
        if held:
            yield close()

    return build


class _Index:
    """The index of one bucket."""

    def __init__(self, folder: str, bucket: int):
        files, path = file_system(folder)
        with files.open_input_file(f"{path}/index-{bucket:05}.npz") as file:
            held = np.load(io.BytesIO(file.read()))
        self.hash = PerfectHash(held["words"], held["bits"])
        self.slots = [held[name] for name, _ in _SLOT]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the keys (int64) are there, and of these shard, number there and copies."""
        keys = keys.view(np.uint64)
        numbers = self.hash.numbers(keys)
        there = numbers >= 0
        there[there] = self.slots[0][numbers[there]] == fingerprints(keys[there])
        return there, [x[numbers[there]].astype(np.int64) for x in self.slots[1:]]


@lru_cache(maxsize=1)
def _index(folder: str, bucket: int) -> _Index | None:
    files, path = file_system(folder)
    if files.get_file_info(f"{path}/index-{bucket:05}.npz").type != fs.FileType.File:
        return None
    return _Index(folder, bucket)


class _Shard:
    """The files of one shard, open for reading."""

    def __init__(self, folder: str, shard: int, width: int):
        files, path = file_system(folder)
        self._ids = files.open_input_file(f"{path}/ids-{shard:05}.bin")
        self._ends = files.open_input_file(f"{path}/ends-{shard:05}.bin")
        self._kind = np.dtype(f"<u{width}")

    def close(self) -> None:
        self._ids.close()
        self._ends.close()

    def bounds(self, first: int, past: int) -> np.ndarray:
        """Where the ids of the documents first to past - 1 begin, and where the last of them end."""
        start = max(first - 1, 0)
        found = np.frombuffer(self._ends.read_at((past - start) * 8, start * 8), dtype="<u8").astype(np.int64)
        return found if first else np.append(0, found)

    def ids(self, start: int, past: int) -> np.ndarray:
        width = self._kind.itemsize
        return np.frombuffer(self._ids.read_at((past - start) * width, start * width), dtype=self._kind).astype("<u4")

    def runs(self, first: int, past: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bounds and ids of the documents first to past - 1, about a block at a time."""
        step = BLOCK // 8
        while first < past:
            bounds = self.bounds(first, min(past, first + step))
            at = 0
            while at < len(bounds) - 1:
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK // 4, "right")) - 1)
                yield bounds[at : end + 1], self.ids(int(bounds[at]), int(bounds[end]))
                at = end
            first += len(bounds) - 1


class TokenFiles:
    """A written folder of token files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()  # one per shard
        self.shards = sorted(rows, key=lambda x: x["shard"])
        self.nulls, self.width, self.buckets = rows[0][5:8] if rows else (0, 4, 1)

    @property
    def _table(self) -> tuple[np.ndarray, ...]:
        """Shard, documents before it and at its end, ids before it."""
        columns = zip(*((x["shard"], x["documents_before"], x["documents"], x["ids_before"]) for x in self.shards), strict=True)
        shard, before, documents, ids = (np.array(x, dtype=np.int64) for x in columns)
        return shard, before, before + documents, ids

    def places(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, number, copies) of every different key that is there; one row per shard that holds it."""
        if not self.shards:
            return self.spark.createDataFrame([], "doc_id long, shard int, number long, copies long")
        folder, nulls, (shard, before, past, _) = self.folder, self.nulls, self._table
        row_of = {x: i for i, x in enumerate(shard.tolist())}

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0)
                known = column.is_valid().to_numpy(zero_copy_only=False)
                if nulls and not known.all():
                    yield from spread(np.zeros(1, dtype=np.int64), [shard[:1], np.zeros(1, np.int64), np.array([nulls])], True)
                keys, buckets = column.fill_null(0).to_numpy()[known], batch.column(1).to_numpy()[known]
                for bucket in np.unique(buckets).tolist():
                    index, asked = _index(folder, bucket), keys[buckets == bucket]
                    if index is not None:
                        there, found = index.find(asked)
                        yield from spread(asked[there], found, False)

        def spread(keys: np.ndarray, found: list[np.ndarray], null: bool) -> Iterator[pa.RecordBatch]:
            """Places that run on into later shards are cut there."""
            at, number, copies = np.array([row_of[x] for x in found[0].tolist()], dtype=np.int64), found[1], found[2]
            while len(keys):
                here = np.minimum(copies, past[at] - before[at] - number)
                columns = [pa.array(keys, mask=np.full(len(keys), null)), pa.array(shard[at], pa.int32()), pa.array(number), pa.array(here)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "number", "copies"])
                more = copies > here
                keys, at, copies = keys[more], at[more] + 1, (copies - here)[more]
                number = np.zeros(len(keys), dtype=np.int64)

        key = F.col(keys.columns[0]).cast("long")
        asked = keys.select(key.alias("doc_id")).distinct().withColumn("bucket", bucket_of(F.col("doc_id"), self.buckets))
        return asked.repartitionById(self.buckets, F.col("bucket")).mapInArrow(
            find, "doc_id long, shard int, number long, copies long"
        )

    def read(self, keys: DataFrame) -> DataFrame:
        """(doc_id, start, n_tokens, ids) of all documents with one of the keys, the first column of a DataFrame.

        start: the ids of all documents before it; ids: raw little-endian unsigned 32-bit numbers.
        """
        schema = "doc_id long, start long, n_tokens long, ids binary"
        if not self.shards:
            return self.spark.createDataFrame([], schema)
        folder, width, (shard, _, _, ids_before) = self.folder, self.width, self._table
        base = dict(zip(shard.tolist(), ids_before.tolist(), strict=True))
        names = [x.split()[0] for x in schema.split(", ")]

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_, shard = None, None
            for batch in batches:
                # Neighbours in a shard are read together.
                keys, shards, numbers, copies = batch.columns
                shards, numbers, copies = (x.to_numpy() for x in (shards, numbers, copies))
                joined = (shards[1:] == shards[:-1]) & (numbers[1:] == numbers[:-1] + copies[:-1])
                for part in np.split(np.arange(len(shards)), np.flatnonzero(~joined) + 1):
                    if not len(part):
                        continue
                    if shards[part[0]] != shard:
                        if open_ is not None:
                            open_.close()
                        shard = int(shards[part[0]])
                        open_ = _Shard(folder, shard, width)
                    first, past = int(numbers[part[0]]), int(numbers[part[-1]] + copies[part[-1]])
                    at = first
                    for bounds, ids in open_.runs(first, past):
                        sizes, raw = np.diff(bounds), ids.tobytes()
                        cells = [raw[a:b] for a, b in zip(((bounds[:-1] - bounds[0]) * 4).tolist(), ((bounds[1:] - bounds[0]) * 4).tolist(), strict=True)]
                        owner = part[np.searchsorted(numbers[part], np.arange(at, at + len(sizes)), "right") - 1]
                        at += len(sizes)
                        columns = [keys.take(pa.array(owner)), pa.array(bounds[:-1] + base[shard]), pa.array(sizes), pa.array(cells, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names)
            if open_ is not None:
                open_.close()

        places = self.places(keys).repartitionById(int(shard.max()) + 1, F.col("shard"))
        return places.sortWithinPartitions("shard", "number").mapInArrow(fetch, schema)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of the documents of one key, read by the caller: one slot of the index, then one stretch of payload."""
        if not self.shards:
            return []
        row = self.spark.range(1).select(bucket_of(F.lit(key), self.buckets)).first()
        index = _index(self.folder, row[0])
        if index is None:
            return []
        there, (shards, numbers, copies) = index.find(np.array([key], dtype=np.int64))
        found = []
        if there[0]:
            left, number = int(copies[0]), int(numbers[0])
            for x in self.shards[[x["shard"] for x in self.shards].index(int(shards[0])) :]:
                here = min(left, x["documents"] - number)
                held = _Shard(self.folder, x["shard"], self.width)
                for bounds, ids in held.runs(number, number + here):
                    found.extend(np.split(ids, bounds[1:-1] - bounds[0]))
                held.close()
                left, number = left - here, 0
                if not left:
                    break
        return found


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> TokenFiles:
    """Encode all texts and write them as token files into a new folder."""
    spark = docs.sparkSession
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(word_ids.VOCABULARY)
    width = word_ids.ids_of(vocabulary).width
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.lit(steps), 10_000)).first()[0] if steps else None
    cuts = cuts or []
    ranged = _encoded(docs, vocabulary, end, cuts).repartitionById(len(cuts) + 1, F.col("part"))
    ranged = ranged.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "row").select("doc_id", "part", "ids")
    entries = ranged.mapInArrow(_write_shards(folder, width), ENTRIES)
    listed = new_folder(spark, "entries")
    entries.write.parquet(listed)
    entries = spark.read.schema(entries.schema).parquet(listed)

    counts = entries.groupBy("shard").agg(
        F.sum("copies").alias("documents"),
        F.sum("ids").alias("ids"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("copies"))), F.lit(0)).alias("nulls"),
    )
    shards = sorted(counts.collect(), key=lambda x: x["shard"])  # one per range
    nulls = sum(x["nulls"] for x in shards)
    buckets = max(parts, -(-sum(x["documents"] for x in shards) // BUCKET_KEYS))
    slots = entries.where("doc_id IS NOT NULL").select(
        bucket_of(F.col("doc_id"), buckets).alias("bucket"), "doc_id", "shard", "number", "copies"
    )
    slots = slots.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "shard")
    slots.mapInArrow(_write_index(folder), "bucket int, keys long").write.parquet(f"{folder}/buckets")
    manifest, documents, ids = [], 0, 0
    for x in shards:
        manifest.append((x["shard"], x["documents"], x["ids"], documents, ids, nulls, width, buckets))
        documents, ids = documents + x["documents"], ids + x["ids"]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")
    return TokenFiles(spark, folder)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Every document's place and the checksum of its ids, read back by key from files written for all documents."""
    files = write(docs, new_folder(docs.sparkSession, "tokens"), vocabulary)
    return files.read(docs.select("doc_id")).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
