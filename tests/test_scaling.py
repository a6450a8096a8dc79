"""Layout and plans that keep the work in proportion to the input."""

from __future__ import annotations

import os
from datetime import datetime, timezone
from types import SimpleNamespace

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from saldo.operators import merge as G
from saldo.plans import sync
from saldo.plans.store import LedgerStore
from saldo.queries import changes, envelopes as E
from saldo.sources import responses as R, sections as D
from saldo.sources.definitions import read_section

AT = datetime(2025, 4, 1, tzinfo=timezone.utc)


def test_markers_of_many_companies_share_files(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    rows = spark.range(300).select(F.col("id").cast("string").alias("company_id"), F.lit("1").alias("alter_id"))
    store.write("change_markers", rows, 0)
    store.commit(0, datetime(2025, 4, 1, tzinfo=timezone.utc))
    store.write("change_markers", rows.filter("id < 10").withColumn("alter_id", F.lit("2")), 1)
    store.commit(1, datetime(2025, 4, 2, tzinfo=timezone.utc))
    files = [f for _, _, names in os.walk(tmp_path / "store" / "change_markers") for f in names if f.endswith(".parquet")]
    assert len(files) < 50
    found = {r["company_id"]: r["alter_id"] for r in store.read("change_markers").collect()}
    assert len(found) == 300 and {c for c, a in found.items() if a == "2"} == {str(i) for i in range(10)}


def test_children_are_not_parsed_again_for_their_number(spark):
    rows = spark.createDataFrame(
        [("c", "g", [("a",), (" ",)], [("l",)]), ("c", "h", [], None), ("c", "i", None, [])],
        "company_id string, tally_guid string, items array<struct<stock_item_name:string>>, ledger_entries array<struct<ledger_name:string>>",
    )
    _, items, entries = G.split_vouchers(rows)
    assert [tuple(r) for r in items.collect()] == [("c", "g", "a")]
    assert [tuple(r) for r in entries.collect()] == [("c", "g", "l")]
    for found in (items, entries):
        assert "size(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_utf16_is_taken_or_left_whole(spark):
    # Lone and paired surrogates, odd lengths and bytes of the surrogates' range in the low place.
    bodies = ["<\x00R\x00E\x00", "=\xd8\x00\xde", "=\xd8a\x00", "\x00\xde", "\xd8\x00", "a\x00b", "\xd8\xd7", "\xe0\xff"]
    rows = spark.createDataFrame([(i, bytearray(b.encode("latin-1"))) for i, b in enumerate(bodies)], "i int, content binary")

    def strict(body: str):
        try:
            return body.encode("latin-1").decode("utf-16-le")
        except UnicodeDecodeError:
            return None

    found = dict(rows.select("i", R._utf16(F.col("content"), "UTF-16LE")).collect())
    assert found == {i: strict(b) for i, b in enumerate(bodies)}


def test_a_batch_is_read_once(spark, tmp_path):
    text = '<ENVELOPE><BODY><DATA><COLLECTION><LEDGER NAME="A"/></COLLECTION></DATA></BODY></ENVELOPE>'
    rows = [(str(i), "ledgers", "1", f"{i}", bytearray(text.encode())) for i in range(5)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    responses = spark.createDataFrame(rows, "company_id string, section string, fetched_at string, path string, content binary")
    counted_responses = responses.mapInArrow(counted, responses.schema)
    store = LedgerStore(spark, str(tmp_path / "store"))
    sync.refresh(store, counted_responses, 0, AT)
    assert read.value == 5 and store.read("ledgers").count() == 5
    sync.refresh(store, responses, 0, AT)  # the same batch again is known by its digest
    assert store.read("ledgers").count() == 5


def test_cleaning_in_one_pass_and_reports_by_their_tags(spark):
    # References in one another or parted by what is dropped; reports in any case and without their closing tag.
    texts = [
        "a\x00&#\x014;&#4;&#x1F;&#10;&#xA;b", "&#&#x4;4;", "&#x&#4;4;", "&&#4;&#4", "&#&#x4;x4;", "\x7f&amp;\t",
        "<Status>0</STATUS><data>no</DATA>", "<STATUS>0<DATA>", "<LINEERROR>x</lineerror>", "<LINEERROR>x", " <response>bad</RESPONSE> ", "ſ İ", None,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert R.clean_responses(rows).collect() == rows.select("i", R.clean_text("text").alias("text")).collect()
    assert R.check_responses(rows).collect() == rows.select("*", R.response_error("text").alias("error")).collect()


def test_texts_are_staged_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "TEXT_GROUP", 1 << 20)
    digests = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2((F.col("id") * 1000 + i).cast("string"), 256))
    rows = spark.range(0, 400, numPartitions=1).select(
        F.lit("1").alias("company_id"), F.lit("groups").alias("section"), F.lit("1").alias("fetched_at"), F.col("id").cast("string").alias("path"),
        F.encode(F.concat(F.lit("<ENVELOPE><!--"), F.array_join(digests, ""), F.lit("--></ENVELOPE>")), "UTF-8").alias("content"),
    )
    staged = sync.Staged(LedgerStore(spark, str(tmp_path / "store")), rows, 0, [])
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{staged.folder}/texts") for f in names if f.endswith(".parquet")]
    groups = [pq.ParquetFile(f).metadata.row_group(i).num_rows for f in files for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(groups) == 400 and max(groups) < 200


def test_landed_files_hold_many_rows(spark, tmp_path):
    rows = spark.range(3000).select(
        F.lit("1").alias("company_id"), F.concat(F.lit("L"), "id").alias("name"), F.lit("Sundry Debtors").alias("group_name"),
        F.lit(1).alias("closing_balance"), F.col("id").alias("master_id"), F.lit("s").alias("state"), F.lit("c").alias("country"), F.lit("g").alias("guid"),
    )
    folder = str(tmp_path / "landing")
    changes.land(SimpleNamespace(spark=spark), E.ledgers(SimpleNamespace(ledgers=rows), E.FILE_ROWS), "ledgers", "1", folder)
    assert len([f for _, _, names in os.walk(folder) for f in names if f.endswith(".txt")]) == 1
    found = read_section(R.prepare(R.read_landing(spark, folder)), D.LEDGERS)
    assert {r["name"] for r in found.collect()} == {f"L{i}" for i in range(3000)}
