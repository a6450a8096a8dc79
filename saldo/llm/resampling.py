"""Target-distribution importance resampling: draw the documents that look most like a target, by hashed n-grams.

The features of a text are its runs of `shortest` to `longest` consecutive words joined by one space, with repeats. Each
falls into the bucket named by the CRC of its bytes. A bucket's gain compares how common it is in the target and in the
documents, a document's weight adds up the gains of its features, and a draw without replacement takes the highest weights
after Gumbel noise that is seeded by the document's id.

CRCs are computed on matrices: the different features of a batch are grouped by length in bytes, each group is a
two-dimensional uint8 array, all its CRCs advance column by column, and the buckets are scattered back to every occurrence.
A feature of more than ROWWISE bytes is a matrix of about one row and goes through zlib instead.

Texts are cut into words once; each document's buckets are written to the shared folder, and the counts and weights are
computed from there. What reaches the driver is one number per bucket and per range of the ranking.

Defined cases: a null text counts as empty; a text without words has no feature and weight 0; rows of equal doc_id are
documents of their own that share their noise; a null doc_id is hashed as the empty string and ranks last among ties;
without a document of enough words, or without documents, nothing is drawn. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm import words as W
from saldo.session import new_folder

BUCKETS = 10_000
SEED = "2024"
#: Of the documents with at least LEAST words, PERCENT of a hundred are drawn.
LEAST = 20
PERCENT = 10
ROWWISE = 256
#: Share of the documents by which the ranked part exceeds the drawn one, as quantiles are approximate.
SPARE = 0.01

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)


def crcs(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The CRC of every slice data[bounds[i]:bounds[i + 1]], those of equal length together, column by column."""
    starts, sizes = bounds[:-1], np.diff(bounds)
    found = np.zeros(len(sizes), dtype=np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, rows in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        if length > ROWWISE:
            found[rows] = [zlib.crc32(data[starts[r] : starts[r] + length]) for r in rows.tolist()]
            continue
        matrix = data[np.arange(length)[:, None] + starts[rows]]  # a row of this is a column of the features
        crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
        for column in matrix:
            crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        found[rows] = ~crc
    return found


def _runs(kept: np.ndarray, bounds: np.ndarray, text: np.ndarray, seen: int, size: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The runs of `size` words within a text, and which text each is of; runs within the first `seen` words are left out."""
    n = len(text)
    if size == 1:
        skipped = bounds[seen:]
        return W.encoded(kept[skipped[0] :], skipped - skipped[0]), text[seen:]
    first = np.arange(n - size + 1) if n >= size else np.empty(0, dtype=np.int64)
    first = first[(text[first] == text[first + size - 1]) & (first + size > seen)]
    # Every word is followed by a space; the runs are slices of that.
    number = np.repeat(np.arange(n), np.diff(bounds))
    spaced = np.full(len(kept) + n, 0x20, dtype=np.uint8)
    spaced[np.arange(len(kept)) + number] = kept
    start, end = bounds[first] + first, bounds[first + size] + first + size - 1
    ends = np.cumsum(end - start)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(start - (ends - (end - start)), end - start) + np.arange(total)
    return W.encoded(spaced[at], np.append(0, ends)), text[first]


def features(column: pa.Array, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, features per text, and the buckets of all features in the order of the texts."""
    rows = len(column)
    n_words = np.zeros(rows, dtype=np.int64)
    found, owners = [], []
    for index, data, begins, seen in W.texts(column, longest - 1):
        kept, bounds, first = W.cut(data, begins)
        per_text = np.diff(np.append(first, len(bounds) - 1))
        np.add.at(n_words, index, per_text)
        n_words[index[0]] -= seen
        text = np.repeat(np.arange(len(index)), per_text)
        for size in range(shortest, longest + 1):
            runs, owner = _runs(kept, bounds, text, seen, size)
            if len(runs):
                values = crcs(*W.slices(runs.dictionary)) % np.uint32(buckets)
                found.append(values[runs.indices.to_numpy()])
                owners.append(index[owner])
    if not found:
        return n_words, np.zeros(rows, dtype=np.int64), np.empty(0, dtype=np.uint32)
    found, owners = np.concatenate(found), np.concatenate(owners)
    if longest > shortest or np.any(owners[1:] < owners[:-1]):
        order = np.argsort(owners, kind="stable")
        found, owners = found[order], owners[order]
    return n_words, np.bincount(owners, minlength=rows), found


BUCKETED = "doc_id long, n_words long, n_features long, buckets binary"


def bucketed(docs: DataFrame, key: str = "doc_id", shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """The buckets of every text's features, as raw little-endian numbers, with its words and features counted."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    names = [x.split()[0] for x in BUCKETED.split(", ")]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, found = features(batch.column(1), shortest, longest, buckets)
            raw, ends = found.astype(kind).tobytes(), np.cumsum(n_features) * kind.itemsize
            cells = [raw[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=False)] if len(ends) else []
            columns = [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(hashed, BUCKETED)


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of raw numbers, and the bounds of its rows."""
    data, bounds = W.slices(column)
    return np.frombuffer(data[bounds[0] : bounds[-1]].tobytes(), dtype=kind), (bounds - bounds[0]) // kind.itemsize


def bucket_counts(made: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; each task adds up its own first."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), kind)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    counted = made.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, dtype=np.int64)
    for row in counted.collect():  # one row per bucket at most
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of how much more common a bucket is in the target, with one count added to each."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratios = (
        (float(t + 1) * float(s_all + n)) / (float(s + 1) * float(t_all + n))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    )
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)


def noise(key: Column, seed: str = SEED) -> Column:
    """Whole thousandths of Gumbel noise, fixed by seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def weighed(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """The sum of the gains of every row's features."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")
    names = [x.split()[0] for x in WEIGHED.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, bounds = _numbers(batch.column(3), kind)
            sums = np.append(0, np.cumsum(gain[numbers]))
            weight = pa.array(sums[bounds[1:]] - sums[bounds[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight], names)

    return made.mapInArrow(add, WEIGHED)


def ranked(scored: DataFrame, drawn: int, candidates: Column, parts: int) -> DataFrame:
    """scored with rank 1 to `drawn` by descending score and ascending doc_id; all candidates are sorted by ranges.

    A row's place is that within its range, numbered by the writing task, and the rows of the ranges before.
    """
    spark = scored.sparkSession
    rows = scored.withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    places = (
        rows.where(candidates)
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .drop("row")
    )
    folder = new_folder(spark, "ranked")
    places.write.parquet(folder)
    places = spark.read.schema(places.schema).parquet(folder).withColumn("part", F.shiftright("place", 33))
    before, sizes = 0, []
    for row in sorted(places.groupBy("part").count().collect()):  # one per range
        sizes.append((row["part"], before))
        before += row["count"]
    offsets = F.broadcast(spark.createDataFrame(sizes, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = places.join(offsets, "part").withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "place", "before")
    return placed.unionByName(scored.where(~candidates).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    shortest: int = 1,
    longest: int = 1,
    buckets: int = BUCKETS,
    least: int = LEAST,
    percent: int = PERCENT,
    seed: str = SEED,
    target_key: str = "item_id",
) -> DataFrame:
    """Every document's features, weight and score, and the rank of those drawn."""
    spark = docs.sparkSession
    folder = new_folder(spark, "buckets")
    made = bucketed(docs, "doc_id", shortest, longest, buckets)
    made.write.parquet(folder)
    made = spark.read.schema(made.schema).parquet(folder)
    wanted = bucketed(target, target_key, shortest, longest, buckets)
    gain = gains(bucket_counts(made, buckets), bucket_counts(wanted, buckets))

    folder = new_folder(spark, "scores")
    scored = weighed(made, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored.write.parquet(folder)
    scored = spark.read.schema(scored.schema).parquet(folder)
    enough = F.col("n_words") >= least
    seen = scored.where(enough).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("score", max(0.0, 1 - percent / 100 - SPARE), 10_000).alias("cut"),
    ).first()
    drawn = percent * seen["n"] // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(columns)
    above = enough & (F.col("score") >= seen["cut"])
    # The quantile is approximate; if it ever were too high, all documents would be ranked.
    candidates = above if scored.where(above).count() >= drawn else enough
    return ranked(scored, drawn, candidates, int(spark.conf.get("spark.sql.shuffle.partitions"))).select(columns)


#: The same in SQL. DuckDB has no CRC, so it is built from its table; words are those of the contract.
ORACLE = r"""
WITH crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i))
),
cut AS (
    SELECT 's' AS side, doc_id AS id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
    UNION ALL
    SELECT 't', item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
),
occurrences AS (SELECT side, id, unnest(words) AS word FROM cut),
vocabulary AS (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, strlen(word) + 1),
            lambda i: CAST('0x' || substr(hex(word), 2 * i - 1, 2) AS BIGINT))),
        lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM occurrences), crc_table
),
held AS (SELECT side, id, word, count(*) AS n FROM occurrences GROUP BY ALL),
counts AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
    FROM held JOIN vocabulary USING (word) GROUP BY bucket
),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts),
gain AS (
    SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE))
        / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
    FROM counts, totals
),
weights AS (
    SELECT id, sum(n * gain) AS weight FROM held JOIN vocabulary USING (word) JOIN gain USING (bucket)
    WHERE side = 's' GROUP BY id
),
scored AS (
    SELECT id AS doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (CAST(CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
    FROM cut LEFT JOIN weights USING (id) WHERE side = 's'
),
places AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)
"""
