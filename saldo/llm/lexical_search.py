"""Ranked lexical search: all documents ranked for every item, term at a time with limited accumulators.

A document's score adds up, over the different terms of the item, the term's weight times a damped frequency: whole
numbers throughout, so results do not depend on the order of the sums.

Documents are cut into terms once: of each, the number of its terms and the counts of those that any item asks for go to the
shared folder. Counts over all documents give the weights. The documents are then searched in blocks, one Arrow batch each,
by every item: its terms come rarest first, each adding its share to the accumulators of the documents that hold it. Once
the best that the remaining terms can give, by the block's own largest shares, is less than the k-th partial score (of the
block or of the blocks that the task has seen), no document that has none yet can reach the first k: no further accumulators
are made, those that cannot reach it either are given up, and the survivors are completed exactly. Each task hands on its k
best per item, which are cut to k per item over salted groups and then once more.

Items are searched in groups whose texts stay below GROUP_BYTES, so what is sent to the tasks is bounded however many items
there are; each group is one pass over the documents.

Defined cases: a null text holds no term and is never found; an item without terms has no rows; texts of equal item_id make
one item, a null item_id too; rows of equal doc_id are documents of their own; a null doc_id ranks last among equal scores.
Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm import words as W
from saldo.llm.resampling import _numbers
from saldo.session import new_folder

K = 50
#: Bytes of item texts per pass; what a task holds of the items is a small multiple of this.
GROUP_BYTES = 16 << 20
#: Groups that the best of the tasks are first cut in, per item.
SALTS = 16

_WORD = np.dtype("<u4")
FORWARD = "doc_id long, n long, terms binary, counts binary"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term as bytes) of every item's different terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, begins, _ in W.texts(batch.column(1)):
                kept, bounds, first = W.cut(data, begins)
                if len(bounds) > 1:
                    owner = np.repeat(rows, np.diff(np.append(first, len(bounds) - 1)))
                    found = W.encoded(kept, bounds)
                    pairs = np.unique(owner * np.int64(len(found.dictionary)) + found.indices.to_numpy())
                    item, term = pairs // len(found.dictionary), pairs % len(found.dictionary)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(item)), found.dictionary.take(pa.array(term))], ["item_id", "term"]
                    )

    rows = items.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "item_id long, term binary").distinct()


def forward(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Of every document the number of its terms, and the terms of the (sorted) vocabulary that it holds with their counts."""
    names = [x.split()[0] for x in FORWARD.split(", ")]
    wanted = pa.array(vocabulary, pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.int64(max(1, len(vocabulary)))
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            keys, counts = [], []
            for rows, data, begins, _ in W.texts(batch.column(1)):
                kept, bounds, first = W.cut(data, begins)
                per_text = np.diff(np.append(first, len(bounds) - 1))
                np.add.at(n, rows, per_text)
                if len(bounds) < 2 or not vocabulary:
                    continue
                found = W.encoded(kept, bounds)
                numbers = pc.index_in(found.dictionary, value_set=wanted).fill_null(-1).to_numpy().astype(np.int64)
                term = numbers[found.indices.to_numpy()]
                held = term >= 0
                key, repeats = np.unique(np.repeat(rows, per_text)[held] * width + term[held], return_counts=True)
                keys.append(key)
                counts.append(repeats)
            key, repeats = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (keys, counts))
            if len(key):  # pieces of one long text have terms in common
                order = np.argsort(key, kind="stable")
                key, first = np.unique(key[order], return_index=True)
                repeats = np.add.reduceat(repeats[order], first)
            ends = np.searchsorted(key, np.arange(1, batch.num_rows + 1) * width) * _WORD.itemsize
            cells = []
            for values in (key % width, repeats):
                raw = values.astype(_WORD).tobytes()
                cells.append([raw[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)] if len(ends) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), *(pa.array(x, pa.binary()) for x in cells)], names
            )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, FORWARD)


def document_frequencies(made: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is; each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column(0), _WORD)[0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    total = np.zeros(size, dtype=np.int64)
    for row in made.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[row["term"]] = row["n"]  # one row per term of the group of items
    return total


def weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequencies.tolist()], dtype=np.int64
    )


class Block:
    """The postings of a batch of documents, each with its share of a score per unit of weight, by term."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, size: int):
        self.documents = len(bounds) - 1
        owner = np.repeat(np.arange(self.documents), np.diff(bounds))
        order = np.argsort(terms, kind="stable")
        self.owner, tf = owner[order], counts[order].astype(np.int64)
        self.share = (1_000_000_000 * tf) // (1000 * tf + 20 * lengths[self.owner])
        self.first = np.searchsorted(terms[order], np.arange(size + 1))
        self.largest = np.zeros(size, dtype=np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.largest[held] = np.maximum.reduceat(self.share, self.first[held])

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with their scores: all of the k best whose score is at least `floor`, and perhaps others.

        terms: those of the item, rarest first; weight: theirs.
        """
        best = weight * self.largest[terms]
        remaining = np.append(np.cumsum(best[::-1])[::-1], 0)  # what the terms from here on can add at most
        scores = np.zeros(self.documents, dtype=np.int64)
        survivors, limited = None, False
        for i in np.flatnonzero(best).tolist():
            threshold = floor
            if not limited and self.documents > k:
                threshold = max(floor, int(np.partition(scores, -k)[-k]))
            if not limited and remaining[i] < threshold:
                limited = True
                survivors = (scores > 0) & (scores + remaining[i] >= threshold)
            part = slice(self.first[terms[i]], self.first[terms[i] + 1])
            if limited:
                owner, share = self.owner[part], self.share[part]
                alive = survivors[owner]
                scores[owner[alive]] += weight[i] * share[alive]
            else:
                scores[self.owner[part]] += weight[i] * self.share[part]
        found = np.flatnonzero(scores > 0 if survivors is None else survivors)
        if len(found) > k:
            least = np.partition(scores[found], -k)[-k]
            found = found[scores[found] >= least]
        return found, scores[found]


def _searcher(queries: list[tuple[int | None, np.ndarray, np.ndarray]], size: int, documents: int, total: int, k: int):
    """The k best documents of a task's rows for every item."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By item, the best so far as a heap, the worst first: score, then the larger id, a null one being the largest.
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            ids = batch.column(0)
            n = batch.column(1).to_numpy()
            lengths = 50 + (50 * n * documents) // max(1, total)
            (terms, bounds), (counts, _) = (_numbers(batch.column(i), _WORD) for i in (2, 3))
            block = Block(terms, counts, bounds, lengths, size)
            for heap, (_, asked, weight) in zip(best, queries, strict=True):
                floor = heap[0][0] if len(heap) == k else 0
                found, scores = block.search(asked, weight, k, floor)
                for key, score in zip(ids.take(pa.array(found)).to_pylist(), scores.tolist(), strict=True):
                    entry = (score, key is not None, 0 if key is None else -key)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        rows = [
            (item, -key if known else None, score)
            for heap, (item, _, _) in zip(best, queries, strict=True)
            for score, known, key in heap
        ]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["item_id", "doc_id", "score"])

    return search


def _cut_to(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of every item's k best documents with a score above 0."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // group_bytes) or 1
    found = None
    for group in range(groups):
        mine = items if groups == 1 else items.where(F.pmod(F.xxhash64(F.col("item_id")), F.lit(groups)) == group)
        asked: dict[int | None, list[bytes]] = {}
        for item, term in item_terms(mine).toLocalIterator():  # bounded by group_bytes
            asked.setdefault(item, []).append(bytes(term))
        part = _search_group(docs, asked, k)
        found = part if found is None else found.unionByName(part)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return _cut_to(_cut_to(salted, ["item_id", "salt"], k).drop("rank", "salt"), ["item_id"], k).select(
        "item_id", "rank", "doc_id", "score"
    )


def _search_group(docs: DataFrame, asked: dict[int | None, list[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({term for terms in asked.values() for term in terms})
    number = {term: i for i, term in enumerate(vocabulary)}
    folder = new_folder(spark, "terms")
    made = forward(docs, vocabulary)
    made.write.parquet(folder)
    made = spark.read.schema(made.schema).parquet(folder)
    all_of = made.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    documents, total = all_of["documents"] or 0, all_of["terms"] or 0
    frequencies = document_frequencies(made, len(vocabulary))
    weight = weights(frequencies, documents)
    queries = []
    for item, terms in asked.items():
        numbers = np.array(sorted(number[t] for t in terms), dtype=np.int64)
        numbers = numbers[np.argsort(frequencies[numbers], kind="stable")]
        queries.append((item, numbers, weight[numbers]))
    return made.mapInArrow(
        _searcher(queries, len(vocabulary), documents, total, k), "item_id long, doc_id long, score long"
    )


#: The same in SQL: every document that shares a term with an item is scored.
ORACLE = r"""
WITH doc_words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM documents
),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
measures AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM lengths, totals),
item_words AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
),
weighted AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM tfs, totals WHERE term IN (SELECT term FROM item_words) GROUP BY term, docs
),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM item_words JOIN weighted USING (term) JOIN tfs USING (term) JOIN measures USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
