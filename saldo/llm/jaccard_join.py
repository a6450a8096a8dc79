"""N-gram Jaccard join: multiple-global-order filtering.

Two documents link when the sets of their distinct five-word shingles have a Jaccard similarity of at least 80 %. Sorted
by any one order of all shingles, the sets of linked documents share a shingle in their prefixes, the first
n - ceil(0.8 n) + 1 of n; in prefixes longer by k - 1 they share k. Several orders are used, and a pair is verified only
if it passes under all of them:

* by hash, over all documents: prefixes long enough to share a tenth of a document. A document of which fewer shingles
  there occur anywhere else is done with; no counts of all shingles are needed for this.
* by rarity, among the others, over prefixes of half a set: the rarest shingles of each, of which those that occur nowhere
  else are left out. Groups of candidates come from these.
* by hash and by another hash, full sets against each other: the prefixes of a pair must meet under both.

Documents of the same set form a class and are compared once. The classes around one rare shingle are compared in blocks,
each within a task and without writing out the pairs: with one pivot, and only what does not link with it with the others,
for what is connected need not be compared again to know the components. No link is lost. Blocks are bounded by classes and
by the shingles that these have together, so a block of very long texts holds few of them.

Hashes have 64 bits; classes are told apart by 128.

Defined cases: a null text, or one without words, has the empty set, links with nothing and is a component of its own;
fewer than five words are one shingle; null ids are never the smallest; equal rows are copies of one class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from saldo.llm.components import components, written
from saldo.llm.shingles import mix, shingle_sets

#: Classes per block, and shingles of these together, about.
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
#: The share of a set that linked ones must share under the order by hash, when rarity is looked at.
SEVERAL = 0.3


def prefix_length(n, k=1):
    """How many shingles of n, in any order, share k with those of every linked set."""
    return n - (4 * n + 4) // 5 + k


def enough(n: int) -> int:
    """How many shingles are asked for under the first order; grows with n."""
    return max(1, n // 10)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    values = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix of every document under the order by hash, and how many of it must occur elsewhere."""
    for batch in batches:
        keys, need, sets = [], [], []
        for key, hashes in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), lower=True), strict=True):
            n = len(hashes)
            if n:
                keys.append(key)
                # A linked document has at least 4/5 as many shingles, and asks for no fewer than this.
                need.append(enough((4 * n + 4) // 5))
                sets.append(hashes[: prefix_length(n, enough(n))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(need, pa.int32()), _lists(sets)], ["doc_id", "need", "tokens"]
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), lower=True))
        high, low = zip(*map(_digest, sets), strict=True) if sets else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), _lists(sets)],
            ["doc_id", "high", "low", "tokens"],
        )


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(s), *_digest(s)) for s in shingle_sets(batch.column(1), lower=True)]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.int64()) for x in columns]], ["doc_id", "n_shingles", "high", "low"]
        )


def _prefix_of_other_order(hashes: np.ndarray) -> np.ndarray:
    length, keys = prefix_length(len(hashes)), mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    return keys if length >= len(keys) else np.partition(keys, length - 1)[:length]


def _candidates(docs: DataFrame) -> DataFrame:
    """The doc_id of the documents that pass the order by hash; null for those without one."""
    made = docs.mapInArrow(_prefixes, "doc_id long, need int, tokens array<long>")
    tokens = made.select("doc_id", "need", F.explode("tokens").alias("token"))
    again = written(tokens.groupBy("token").count().where("count > 1").select("token"), "repeated")
    # One plan at every size: a table of repeated shingles grows with the documents and is never broadcast.
    found = tokens.join(again.hint("merge"), "token").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    return written(found.where("n >= need").select("doc_id"), "candidates")


def classes(docs: DataFrame) -> DataFrame:
    """Classes that may have links or copies: class, high, low, first_id, copies, n, tokens."""
    some = _candidates(docs).select(F.col("doc_id").alias("id"))
    # Candidates grow with the documents too, and so do the groups below: merge joins at every size.
    texts = docs.join(some.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    made = texts.mapInArrow(_sets, "doc_id long, high long, low long, tokens array<long>").where("size(tokens) > 0")
    grouped = made.groupBy("high", "low").agg(
        F.min("doc_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("tokens").alias("tokens"),
    )
    return written(
        grouped.select(
            F.monotonically_increasing_id().alias("class"), "high", "low", "first_id", "copies",
            F.size("tokens").cast("long").alias("n"), "tokens",
        ),
        "classes",
    )


def rare_prefixes(sets: DataFrame) -> DataFrame:
    """(token, class): of each class the shingles that one of any linked class must be among, by rarity.

    The order by rarity is over the prefixes under the order by hash that are long enough to share SEVERAL of n: linked
    classes share that many there, so that one is among the rarest but so many. What occurs in no other prefix comes
    first in the order and cannot be shared: so many fewer are left to take.
    """
    several = lambda n: F.floor(F.expr(n) * SEVERAL).cast("int")
    taken = F.least(F.col("n"), F.expr("n - (4 * n + 4) div 5") + F.greatest(F.lit(1), several("n")))
    tokens = sets.select("class", F.explode(F.slice("tokens", 1, taken.cast("int"))).alias("token"))
    rarity = written(tokens.groupBy("token").count().where("count > 1"), "rarity")
    shared = (
        tokens.join(rarity.hint("merge"), "token")
        .groupBy("class")
        .agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("shared"))
        .join(sets.select("class", "n"), "class")
    )
    # A linked class has at least 4/5 as many shingles, and shares no fewer than this.
    left = F.size("shared") - F.greatest(F.lit(1), several("(4 * n + 4) div 5")) + 1
    return written(
        shared.where(left > 0)
        .select("class", F.explode(F.slice("shared", 1, left.cast("int"))).alias("s"))
        .select("s.token", "class"),
        "rare",
    )


def links_of_classes(sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes that connect all that is connected; not every link within a component.

    The classes around a shingle are one group, called by the smallest of them, the pivot; shingles of the same classes
    mostly have the same pivot. A group is dealt into blocks by a digest, and the pivot put into each of them. Within a
    block each class is compared with the pivot, and those that do not link with it with all others.
    """
    rare = rare_prefixes(sets)
    pivots = rare.groupBy("token").agg(F.min("class").alias("pivot"))
    around = written(rare.join(pivots, "token").select("pivot", "class").distinct(), "around")
    # A group whose pivot lies in the group of a smaller one joins that, so that its classes do not stand in both.
    smaller = around.groupBy("class").agg(F.min("pivot").alias("first"))
    groups = around.join(smaller.withColumnRenamed("class", "pivot"), "pivot").select(F.col("first").alias("pivot"), "class")
    groups = groups.unionByName(groups.select("pivot", F.col("pivot").alias("class"))).distinct()
    sizes = sets.select("class", "n")
    counts = groups.join(sizes, "class").groupBy("pivot").agg(_blocks_for(F.lit(True), BLOCK).alias("blocks"), F.count(F.lit(1)).alias("size"))
    groups = groups.join(counts.where("size > 1").select("pivot", "blocks"), "pivot")
    at = F.when(F.col("pivot") == F.col("class"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    )
    groups = written(groups.select("pivot", "class", "blocks", F.explode(at).alias("block")), "groups")
    rows = groups.hint("merge").join(sets.select("class", "n", "tokens"), "class")
    links = written(rows.groupBy("pivot", "block").applyInPandas(_within, "a long, b long").distinct(), "links")
    # Groups of several blocks: what is still apart in different blocks is compared across them.
    parted = groups.where("blocks > 1").select("pivot", "class").distinct()
    found = components(links).withColumnRenamed("node", "class")
    placed = parted.join(found, "class", "left").withColumn("place", F.coalesce("component", "class"))
    home = placed.where("pivot = class").select("pivot", F.col("place").alias("home"))
    placed = placed.join(home, "pivot").select("pivot", "class", "place", (F.col("place") != F.col("home")).alias("out"))
    return links.unionByName(links_across(written(placed, "placed"), sets))


def _blocks_for(chosen, block: int):
    """How many blocks a group's chosen classes are dealt into."""
    several = F.greatest(F.count_if(chosen) / block, F.sum(F.when(chosen, F.col("n"))) / BLOCK_SHINGLES)
    return F.coalesce(F.ceil(several), F.lit(0)).cast("int")


def links_across(placed: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) within each group (pivot) between classes of different places, one of them out of the pivot's place.

    The classes out of place, and those in it, are dealt into blocks by a digest; each block of the former meets every
    block of the group in a task of its own, which returns one link at most for two places.
    """
    counts = placed.join(sets.select("class", "n"), "class").groupBy("pivot").agg(
        _blocks_for(F.col("out"), block).alias("outs"), _blocks_for(~F.col("out"), block).alias("ins")
    )
    rows = placed.join(counts.where("outs > 0"), "pivot")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("class"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))))
    # Blocks out of place are 0, 1, ...; those in it follow.
    rows = rows.withColumn("at", F.expr("cast(IF(out, at, at + outs) AS int)"))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0, IF(out, outs + ins, outs) - 1)")))
    rows = rows.select("pivot", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "at", "class", "place")
    rows = rows.hint("merge").join(sets.select("class", "n", "tokens"), "class")
    return rows.groupBy("pivot", "i", "j").applyInPandas(_across, "a long, b long").distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the left sets has in common with each of the right sets."""
    sizes = [len(x) for x in (*left, *right)]
    both = np.zeros((len(left), len(right)), dtype=np.float64)
    _, codes, counts = np.unique(np.concatenate((*left, *right)), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    shared = counts[codes] > 1
    codes, rows = (np.cumsum(counts > 1) - 1)[codes[shared]], rows[shared]
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    width = 2048
    for at in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        here = slice(*np.searchsorted(codes, (at, at + width)))
        table = np.zeros((len(sizes), width), dtype=np.float32)
        table[rows[here], codes[here] - at] = 1
        both += table[: len(left)] @ table[len(left) :].T
    return both


def _blocks(frame: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks of a group; the same one twice if it meets itself."""
    first = frame[frame["at"] == frame.i.iloc[0]].reset_index(drop=True)
    second = frame[frame["at"] == frame.j.iloc[0]].reset_index(drop=True)
    return first, (first if frame.i.iloc[0] == frame.j.iloc[0] else second)


def _linked(left: pd.DataFrame, right: pd.DataFrame, asked: np.ndarray) -> np.ndarray:
    """Which of the asked pairs link; a pair is compared only if its prefixes meet under both orders by hash."""
    xs, ys = ([np.asarray(t, dtype=np.int64).view(np.uint64) for t in part.tokens] for part in (left, right))
    n, m = left.n.to_numpy()[:, None], right.n.to_numpy()[None, :]
    asked = asked & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
    linked = np.zeros_like(asked)
    for prefix in (lambda x: x[: prefix_length(len(x))], _prefix_of_other_order, None):
        rows, columns = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
        if not len(rows):
            return linked
        change = prefix or (lambda x: x)
        both = _overlaps([change(xs[i]) for i in rows], [change(ys[j]) for j in columns])
        part = np.ix_(rows, columns)
        if prefix:
            asked[part] &= both > 0
        else:
            linked[part] = asked[part] & (100 * both >= 80 * (n[rows] + m[:, columns] - both))
    return linked


_NO_LINKS = {"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")}


def _within(frame: pd.DataFrame) -> pd.DataFrame:
    """Links within one block of a group: of the pivot, and of what does not link with it."""
    frame = frame.sort_values("class").reset_index(drop=True)
    own = frame[frame["class"] == frame["pivot"]].reset_index(drop=True)
    linked = _linked(own, frame, (frame["class"] != frame["pivot"]).to_numpy()[None, :])[0]
    rest = frame[~linked & (frame["class"] != frame["pivot"]).to_numpy()].reset_index(drop=True)
    names = frame["class"].to_numpy()
    found = [pd.DataFrame({"a": names[linked], "b": int(frame["pivot"].iloc[0])})]
    if len(rest):
        i, j = np.nonzero(_linked(rest, frame, rest["class"].to_numpy()[:, None] != names[None, :]))
        # One link of each to the classes that hang on the pivot, and all among the others, in one direction.
        more = pd.DataFrame({"a": rest["class"].to_numpy()[i], "b": names[j], "hangs": linked[j]})
        found.append(more[more.hangs].drop_duplicates("a")[["a", "b"]])
        others = more[~more.hangs & (more.a > more.b)]
        found.append(_forest(others[["a", "b"]]))
    return pd.concat(found)


def _forest(links: pd.DataFrame) -> pd.DataFrame:
    """Of links those that connect anew, in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for a, b in zip(links.a.tolist(), links.b.tolist(), strict=True):
        x, y = root(a), root(b)
        kept.append(x != y)
        if x != y:
            parent[x] = y
    return links[np.array(kept, dtype=bool)]


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """One link at most for two places, between two blocks."""
    left, right = _blocks(frame)
    if not len(left) or not len(right):
        return pd.DataFrame(_NO_LINKS)
    i, j = np.nonzero(_linked(left, right, left.place.to_numpy()[:, None] != right.place.to_numpy()[None, :]))
    found = pd.DataFrame({"a": left["class"].to_numpy()[i], "b": right["class"].to_numpy()[j]})
    found["p"], found["q"] = left.place.to_numpy()[i], right.place.to_numpy()[j]
    return found.drop_duplicates(["p", "q"])[["a", "b"]]


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes that may have links or copies, and (class, component) of each."""
    sets = classes(docs)
    found = components(links_of_classes(sets)).withColumnRenamed("node", "class")
    # Classes without links to others are components of their own.
    placed = sets.select("class").join(found, "class", "left")
    return sets, written(placed.withColumn("component", F.coalesce("component", "class")), "placed")


def joined(docs: DataFrame) -> DataFrame:
    """Per document its number of shingles and its component (smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets, placed = _placed(docs)
    keys = sets.select("class", "high", "low", "first_id").join(placed, "class")
    first = keys.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = written(keys.join(first, "component").select("high", "low", "component_id"), "known")
    sizes = docs.mapInArrow(_sizes, "doc_id long, n_shingles long, high long, low long")
    return sizes.join(known, ["high", "low"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


@F.arrow_udf(StructType([StructField("high", LongType()), StructField("low", LongType())]))
def set_digest(texts: pa.Array) -> pa.Array:
    """The digest of the shingle set of every text."""
    rows = [_digest(s) for s in shingle_sets(texts, lower=True)]
    high, low = zip(*rows, strict=True) if rows else ((), ())
    return pa.StructArray.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["high", "low"])


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, one with the smallest doc_id; all rows without shingles stay.

    Of rows of a component that share this id, one of the class with the smallest digest stays. A component without any
    id keeps one row too.
    """
    columns = docs.columns
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sets, placed = _placed(plain)
    keys = sets.select("class", "high", "low", "first_id").join(placed, "class")
    first = keys.groupBy("component").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "high", "low")).alias("_first")
    )
    known = written(keys.join(first, "component").select("high", "low", "component", "_first"), "known")
    rows = docs.select(
        F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
        set_digest(F.coalesce("text", F.lit(""))).alias("d"),
    )
    rows = rows.select("row", "id", "d.high", "d.low").join(known, ["high", "low"], "left")
    kept = rows.where(
        "component IS NULL OR (id <=> _first.first_id AND high = _first.high AND low = _first.low)"
    )
    # Only where ids repeat can several rows be left of a component.
    ids = plain.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if known.join(ids, F.col("_first.first_id").eqNullSafe(F.col("again")), "left_semi").limit(1).count():
        kept = kept.where("component IS NULL").unionByName(
            kept.where("component IS NOT NULL").dropDuplicates(["component"])
        )
    return kept.select("row.*")
