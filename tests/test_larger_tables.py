"""What keeps disk and time in proportion on larger tables: packed files, freed shuffles, expressions that are computed once."""

from __future__ import annotations

import gzip
import os
import threading
from datetime import date, datetime, timezone
from types import SimpleNamespace

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from saldo.functions import scalars as S
from saldo.plans import sync
from saldo.plans.store import LedgerStore
from saldo.queries import changes, envelopes as E
from saldo.session import CLEANUP, shuffles_freed
from saldo.sources import responses as R, sections as D
from saldo.sources.definitions import parse_documents, staged_rows
from saldo.streaming.refresh import start_refresh

AT = datetime(2025, 4, 1, tzinfo=timezone.utc)


def ledgers(*names: str) -> str:
    rows = "".join(f'<LEDGER NAME="{n}"><CLOSINGBALANCE>1,5 Dr</CLOSINGBALANCE></LEDGER>' for n in names)
    return f"<ENVELOPE><BODY><DATA><COLLECTION>{rows}</COLLECTION></DATA></BODY></ENVELOPE>"


def responses_of(spark, *rows):
    columns = "company_id string, section string, fetched_at string, path string, content binary"
    return spark.createDataFrame([(*r[:-1], bytearray(r[-1].encode())) for r in rows], columns)


def test_packed_landing_files_are_read_with_plain_ones(spark, tmp_path):
    texts = {"a+b": ledgers("é 1", "2").encode("utf-16"), "c d": ledgers("3").encode()}
    for company, content in texts.items():
        folder = tmp_path / "landing" / f"company={company}" / "section=ledgers" / "fetched_at=1"
        folder.mkdir(parents=True)
        (folder / "x.gz").write_bytes(gzip.compress(content))
        (folder / "y.txt").write_bytes(ledgers("plain").encode())
    store = LedgerStore(spark, str(tmp_path / "store"))
    # A packed file counts as one row, whatever the limit.
    start_refresh(spark, str(tmp_path / "landing"), store, str(tmp_path / "checkpoint"), every=None, clock=lambda: AT).awaitTermination()
    found = sorted((r["company_id"], r["name"]) for r in store.read("ledgers").collect())
    assert found == [("a+b", "2"), ("a+b", "plain"), ("a+b", "é 1"), ("c d", "3"), ("c d", "plain")]


def test_refreshed_lands_packed_files(spark, tmp_path):
    docs = spark.createDataFrame([("1", 0, bytearray(ledgers("A").encode()))], "company_id string, chunk int, content binary")
    docs = docs.withColumn("content_type", F.lit(None).cast("string"))
    changes.land(SimpleNamespace(spark=spark), docs, "ledgers", "1", str(tmp_path / "landing"), "gzip")
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "landing") for f in names if f.startswith("part-")]
    assert [gzip.open(f).read().decode().strip() for f in files] == [ledgers("A")]


def test_texts_are_packed_and_go_once_staged(spark, tmp_path, monkeypatch):
    store, seen, codecs = LedgerStore(spark, str(tmp_path / "store")), [], set()
    write, drop = store.write, sync.Staged.drop_texts

    def dropped(staged):
        for d, _, names in os.walk(staged.folder):
            codecs.update(pq.ParquetFile(f"{d}/{f}").metadata.row_group(0).column(0).compression for f in names if f.endswith(".parquet"))
        drop(staged)

    def noted(table, rows, batch_id):
        seen.append((table, os.path.exists(f"{store.root}/_staged/batch_id={batch_id}/texts"), spark.conf.get(CLEANUP)))
        write(table, rows, batch_id)

    monkeypatch.setattr(sync.Staged, "drop_texts", dropped)
    monkeypatch.setattr(store, "write", noted)
    before = spark.conf.get(CLEANUP, None)
    sync.refresh(store, responses_of(spark, ("1", "ledgers", "1", "p", ledgers("A")), ("2", "odd", "1", "q", "<ENVELOPE/>")), 0, AT)
    assert codecs == {"ZSTD"} and spark.conf.get(CLEANUP, None) == before
    assert {t for t, _, _ in seen} >= {"documents", "ledgers"} and all(not texts and free == "true" for _, texts, free in seen)
    assert [r["name"] for r in store.read("ledgers").collect()] == ["A"]
    errors = {r["section"]: r["error"] for r in store.committed("documents").collect()}
    assert errors == {"ledgers": None, "odd": "Unknown section"}


def test_what_a_store_does_not_hold_is_not_joined(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    store.write("change_markers", spark.createDataFrame([("1", "7")], "company_id string, alter_id string"), 0)
    store.commit(0, AT)
    standing = store.standing("change_markers")
    assert "Join" not in standing._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["company_id"], r["alter_id"]) for r in standing.collect()] == [("1", "7")]
    assert store.read("vouchers").schema["date"].dataType.simpleString() == "date" and store.read("vouchers").count() == 0
    store.remove_companies(spark.createDataFrame([("1",)], "company_id string"), "9")
    store.write("change_markers", spark.createDataFrame([("1", "8", "8")], "company_id string, alter_id string, fetched_at string"), 1)
    store.commit(1, AT)
    assert store.standing("change_markers").count() == 0  # a removal that there is still holds


def test_shuffle_files_go_with_their_jobs_and_settings_come_back(spark, tmp_path):
    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before, files = spark.conf.get(CLEANUP, None), shuffled()
    inside, leave = threading.Event(), threading.Event()

    def other():
        with shuffles_freed(spark):
            inside.set()
            leave.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with shuffles_freed(spark):
        spark.range(1000).repartition(5, "id").write.parquet(str(tmp_path / "x"))
    assert spark.conf.get(CLEANUP) == "true"
    leave.set()
    thread.join()
    assert spark.conf.get(CLEANUP, None) == before and not shuffled() - files


def test_numbers_are_cut_out_once(spark):
    texts = [None, "", " ", "12\x85", "12 ", "1_0.5e1/x", " -1,200.50 Nos", "/5 x", "5d", "inf", "- 5", "1 2 3", "\t3 pcs.", "a1", "1 \n a", "1\xa0a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")

    def old_float(c):
        token = F.replace(F.regexp_extract(c, r"^\s*([^\s/]*)", 1), F.lit(","), F.lit(""))
        return F.coalesce(F.when(token.rlike(S.NUMBER), F.replace(token, F.lit("_"), F.lit("")).try_cast("double")), F.lit(0.0))

    second, only = F.regexp_extract("t", r"^\s*\S+\s+(\S+)", 1), S.first_token("t")
    old_unit = F.coalesce(F.when(second != "", second).when(only.rlike(r"\p{L}"), only), F.lit(""))
    old = rows.select("t", old_float(F.col("t")), F.abs(old_float(only)), old_unit)
    new = rows.select("t", S.safe_float("t").alias("f"), S.quantity_value("t").alias("q"), S.quantity_unit("t").alias("u"))
    assert [tuple(r) for r in new.collect()] == [tuple(r) for r in old.collect()]
    plan = rows.select(S.quantity_value("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") <= 4 and "RLIKE" not in plan.upper()  # in the name and in the expression


def test_values_come_trimmed_from_the_parser(spark):
    blank = "\t\n &#32;"
    text = (
        f'<ENVELOPE><BODY><DATA><COLLECTION><LEDGER NAME="{blank}a{blank}"><PARENT>{blank}<![CDATA[ p ]]>{blank}</PARENT>'
        f"<EMAIL>{blank}</EMAIL><EMAIL> x </EMAIL><EMAIL>y</EMAIL><CLOSINGBALANCE>{blank}5 Dr</CLOSINGBALANCE></LEDGER></COLLECTION></DATA></BODY></ENVELOPE>"
    )
    checked = R.prepare(responses_of(spark, ("1", "ledgers", "1", "p", text)))
    rows = staged_rows(parse_documents(checked, D.LEDGERS), D.LEDGERS)
    found = rows.first()
    assert [found[c] for c in ("name", "group_name", "email", "phone", "closing_balance", "valid")] == ["a", "p", "x, y", "", 5, True]
    assert "btrim" not in rows.select("name", "group_name", "email")._jdf.queryExecution().analyzed().toString()


def test_items_are_written_before_they_are_gathered(spark):
    vouchers = spark.createDataFrame(
        [("1", "7", "VCH-7", "Sales", date(2025, 4, 1), "P", 5, "n", "", False, False, True), ("1", "8", "VCH-8", "Payment", None, "P", 5, "n", "", False, False, False)],
        "company_id string, tally_guid string, voucher_number string, voucher_type string, date date, party_name string, amount int, "
        "narration string, reference string, is_cancelled boolean, is_optional boolean, is_invoice boolean",
    )
    items = spark.createDataFrame(
        [("1", "7", 0, "b", 10, "Nos", 1, 0, 10), ("1", "7", 1, "a", 9, "Nos", 1, 0, 9), ("1", "7", 2, "a", 10, "Nos", 1, 0, 10), ("1", "7", 3, "a<", 1, "Nos", 1, 0, 1)],
        "company_id string, tally_guid string, line int, stock_item_name string, quantity int, unit string, rate int, discount_pct int, amount int",
    )
    docs = E.vouchers(SimpleNamespace(vouchers=vouchers, items=items))
    rows = staged_rows(parse_documents(R.prepare(docs), D.VOUCHERS), D.VOUCHERS)
    found = {r["tally_guid"]: [(i["stock_item_name"], int(i["quantity"])) for i in r["items"]] for r in rows.collect()}
    assert found == {"7": [("a", 9), ("a", 10), ("a<", 1), ("b", 10)], "8": []}
    assert "lambda" not in docs._jdf.queryExecution().analyzed().toString()


def test_both_stores_of_split_batches_are_filled_side_by_side(spark, tmp_path, monkeypatch):
    both, batches = threading.Barrier(2, timeout=60), []
    docs = spark.createDataFrame([(f"p{i}",) for i in range(6)], "path string")

    def refresh(store, rows, batch, at):
        if batch == 0:
            both.wait()  # fails unless the other store is being filled too
        batches.append((batch, sorted(r["path"] for r in rows.collect())))

    monkeypatch.setattr(changes, "parted", lambda m: {})
    monkeypatch.setattr(changes, "landing_rows", lambda m, sections, stamp: docs)
    monkeypatch.setattr(changes.Y, "refresh", refresh)
    row = spark.createDataFrame([("t", "1", "n", 1)], "table string, company_id string, name string, amount int")
    monkeypatch.setattr(changes, "named", lambda store, name: row)
    found = changes.split_batches(SimpleNamespace(spark=spark)).collect()
    assert [(r["stores"], r["least"], r["most"]) for r in found] == [(2, len(changes.SPLIT), len(changes.SPLIT))]
    assert sorted(p for _, paths in batches for p in paths) == sorted(f"p{i}" for i in range(6) for _ in range(2))
