"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the document and
sketches of very unequal documents can be compared and merged. A text with fewer than FLOOR such hashes keeps its FLOOR
smallest ones; up to which hash a sketch is whole can be read off the sketch (`bound`), and two sketches are compared
below the smaller of their bounds. As text a sketch is its hashes as 16 hex digits each, ascending.

Defined cases: a null text counts as empty; a text without words has the empty sketch, which is wholly like another
empty one (1.0) and unlike any other (0.0); one with fewer words than a shingle has one shingle; white space and its
kind do not matter. Equal texts have equal sketches. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.shingles import distinct, shingle_sets

FRACTION = 1 / 8
FLOOR = 32
_ALL = 2**64


def sketch(hashes: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """The retained hashes of a set of distinct, ascending shingle hashes."""
    below = int(np.searchsorted(hashes, np.uint64(int(fraction * _ALL))))
    return hashes[: max(below, floor)]


def bound(kept: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> int:
    """The sketch holds every hash of its document that is smaller than this."""
    limit = int(fraction * _ALL)
    if len(kept) < floor:
        return _ALL
    return max(limit, int(kept[-1]) + 1) if len(kept) == floor else limit


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """The sketch of both documents together."""
    return sketch(distinct(np.concatenate((a, b))), fraction, floor)


def compare(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> tuple[float, float]:
    """Estimates of the resemblance of two documents, and of the share of the first that the second contains."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, same
    limit = min(bound(a, fraction, floor), bound(b, fraction, floor))
    if limit < _ALL:
        a, b = (x[: int(np.searchsorted(x, np.uint64(limit)))] for x in (a, b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return (both / either if either else 0.0), (both / len(a) if len(a) else 0.0)


def to_text(kept: np.ndarray) -> str:
    return kept.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64)


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the sketch of its text column, as text."""

    @F.pandas_udf("string")
    def fingerprint(texts):
        import pandas as pd

        column = pa.array(texts, pa.large_string())
        return pd.Series([to_text(sketch(s)) for s in shingle_sets(column)], dtype=object)

    return df.withColumn(out, fingerprint(F.coalesce(F.col(text), F.lit(""))))


def in_id_order(df: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, own) so that each row's successor in descending doc_id follows it in the same partition.

    Rows are dealt into at most `parts` ranges of doc_id. The first row of a range comes a second time, with own
    false, at the end of the range before it; that of the first range at the end of the last. Only one number and one
    key per range pass the driver. Rows of equal doc_id follow each other by a digest of the text; null ids come last.
    """
    spark = df.sparkSession
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    steps = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit(steps), 10_000)).first()[0] if steps else None
    cuts = sorted(set(cuts or ()))
    place = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in cuts]), lambda x: x > F.col("doc_id")))
    place = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(place) if cuts else F.lit(0)
    rows = rows.withColumn("part", place.cast("int"))
    first = rows.groupBy("part").agg(F.max(F.struct("doc_id", "digest")).alias("first")).orderBy("part").collect()
    heads = [(*row["first"], first[i - 1]["part"]) for i, row in enumerate(first)]
    heads = F.broadcast(spark.createDataFrame(heads, "head long, head_digest long, before int"))
    places = F.array(
        F.struct(F.col("part"), F.lit(True).alias("own")), F.struct(F.col("before").alias("part"), F.lit(False).alias("own"))
    )
    return (
        rows.join(heads, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("digest") == F.col("head_digest")), "left")
        .select("doc_id", "text", "digest", F.explode(F.filter(places, lambda x: x.part.isNotNull())).alias("at"))
        .select("doc_id", "text", "digest", "at.part", "at.own")
        .repartitionById(max(1, len(cuts) + 1), F.col("part"))
        .sortWithinPartitions(F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("digest"))
        .select("doc_id", "text", "own")
    )


EDITED = """doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
near_edited double, near_next double, contained_edited double, contained_next double"""


def edited(text: str, after: str) -> str:
    """text with its last third replaced by as much of the beginning of the next text, or all of that."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third] if third else text


def _compare_with_edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's fingerprint beside those of its edited text and of the row after it."""
    names = [x.split()[0] for x in EDITED.replace("\n", " ").split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]
    held = None
    for batch in batches:
        column = batch.column(1)
        rows = list(
            zip(
                batch.column(0).to_pylist(),
                column.to_pylist(),
                batch.column(2).to_pylist(),
                map(sketch, shingle_sets(column)),
                strict=True,
            )
        )
        if held is not None:
            rows.insert(0, held)
        if not rows:
            continue
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[2]]
        if not pairs:
            continue
        changed = [edited(a[1], b[1]) for a, b in pairs]
        out = []
        for (a, b), text, own in zip(pairs, changed, map(sketch, shingle_sets(pa.array(changed, pa.large_string()))), strict=True):
            (near, part), (near_next, part_next) = compare(a[3], own), compare(a[3], b[3])
            digest = hashlib.sha256(text.encode()).hexdigest()
            out.append((a[0], len(a[1]), digest, to_text(a[3]), to_text(own), near, near_next, part, part_next))
        columns = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document the fingerprint of its text and of its edited text, and their likeness; one sort by ranges of doc_id.

    The edited text is the text with its last floor(n/3) code points replaced by as many first ones of the document
    next in descending doc_id (after the last, the first), or by all of it if that is shorter.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_id_order(docs, parts).mapInArrow(_compare_with_edited, EDITED)
