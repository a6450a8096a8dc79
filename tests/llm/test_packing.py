"""Packing by supersteps against best-fit decreasing, and the parts of a superstep against one plain stack."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saldo.llm import packing
from tests.llm.best_fit import sequences


def made(spark, lengths):
    rows = [(i, n, "x") for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "id long, length long, other string").repartition(3)


def check(rows, lengths, capacity):
    """Every piece is there once, sequences are gapless and not too long; gives their number."""
    assert Counter(r.length for r in rows) == Counter(lengths)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("seed", [1, 3, 5])
def test_as_many_sequences_as_best_fit_decreasing(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "RANGE_ROWS", 20)
    rng = random.Random(seed)
    capacity = [64, 100, 1024, 1024, 16, 7][seed]
    top = [64, 45, 1024, 300, 16, 7][seed]
    lengths = [rng.randint(1, top) for _ in range(rng.randint(150, 400))]
    if seed == 3:
        lengths += [300] * 120  # one length that a third of all pieces have
    rows = packing.pack(spark, made(spark, lengths), capacity).collect()
    assert check(rows, lengths, capacity) == sequences(Counter(lengths), capacity)
    assert {r.other for r in rows} == {"x"}


@pytest.mark.parametrize("lengths", [[], [5], [64], [33, 31], [1] * 130, [32, 32, 32], [40, 24, 24, 20, 4]])
def test_few_pieces(spark, lengths):
    rows = packing.pack(spark, made(spark, lengths), 64).collect()
    assert check(rows, lengths, 64) == sequences(Counter(lengths), 64)


def test_bands_cover_all_lengths_up_to_half():
    for capacity in (7, 16, 64, 1000, 1024):
        lengths = dict.fromkeys(range(1, capacity + 1), 1)
        found = list(packing.bands(lengths, capacity))
        assert [x for low, high in found for x in range(high, low, -1)] == list(range(capacity // 2, 0, -1))


def test_ranges_settled_match_as_one_stack():
    rng = random.Random(4)
    for _ in range(200):
        events = sorted(((rng.randint(1, 30), rng.randint(0, 1), i) for i in range(rng.randint(0, 60))), key=lambda e: (-e[0], e[1], e[2]))
        stack, whole = [], {}
        for _, kind, key in events:
            if kind == packing.GAP:
                stack.append(key)
            elif stack:
                whole[key] = stack.pop()
        cuts = sorted(rng.randint(0, len(events)) for _ in range(4))
        found, ranges, pieces, gaps = {}, [], {}, {}
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(events)])):
            own, missed = [], []
            for _, kind, key in events[a:b]:
                if kind == packing.GAP:
                    own.append(key)
                elif own:
                    found[key] = own.pop()
                else:
                    missed.append(key)
            pieces[part], gaps[part] = missed, own
            ranges.append(packing._Range(part, len(own), len(missed), 0, 0))
        moves, done = packing.settle(ranges)
        for part, first, past, above, top in moves:
            for at in range(first, past):
                found[pieces[part][at]] = gaps[above][top - (at - first)]
        assert found == whole
        assert sum(done.values()) == sum(past - first for _, first, past, _, _ in moves)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.packed(docs).collect()
    assert check(rows, [r.length for r in rows], 1024) == sequences(Counter(r.length for r in rows))
    again = packing.packed(docs.select("text", F.lit(1).alias("id"), F.lit(2).alias("room"), "doc_id")).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in rows) == Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in again)


def test_placed_pieces_are_read_back_as_few_tables(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 20)
    rng = random.Random(9)
    lengths = [rng.randint(1, 60) for _ in range(60)]
    found = packing.pack(spark, made(spark, lengths), 64)
    assert check(found.collect(), lengths, 64) == sequences(Counter(lengths), 64)
    # The plan does not grow with the supersteps: large pieces, small ones, and three ways of finding a place.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 5
