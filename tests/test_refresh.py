"""The store, the refresh and the stream on small landed files."""

import zlib
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from saldo.operators import merge as G
from saldo.plans import sync
from saldo.plans.store import LedgerStore
from saldo.sources import responses as R, sections as X
from saldo.sources.large import read_large_export
from saldo.streaming.refresh import start_refresh
from tests.test_sections import PNL, RECEIVABLES, collection, voucher

AT = datetime(2025, 6, 1, tzinfo=timezone.utc)


def landed(spark, *responses):
    """Documents named by what they hold, as the same name is the same document in whatever batch it comes."""
    rows = [(c, s, stamp, f"{c}/{s}/{stamp}/{zlib.crc32(t.encode())}", bytearray(t.encode())) for c, s, stamp, t in responses]
    return spark.createDataFrame(rows, "company_id string, section string, fetched_at string, path string, content binary")


def marks(alter, voucher, master, last="20250501"):
    return collection(f"<COMPANY><ALTERID>{alter}</ALTERID><ALTVCHID>{voucher}</ALTVCHID><ALTMSTID>{master}</ALTMSTID><LASTVOUCHERDATE>{last}</LASTVOUCHERDATE></COMPANY>")


def ledgers(*names):
    return collection("".join(f'<LEDGER NAME="{n}"><CLOSINGBALANCE>{b}</CLOSINGBALANCE></LEDGER>' for n, b in names))


def everything(store):
    out = {}
    for table in ("ledgers", "vouchers", "voucher_items", "voucher_ledger_entries", "outstanding", "profit_loss", "change_markers", "companies"):
        rows = store.read(table)
        out[table] = sorted(map(str, rows.select(sorted(rows.columns)).collect()))
    return out


def balances(store):
    return {(r["company_id"], r["name"]): int(r["closing_balance"]) for r in store.read("ledgers").collect()}


NOTHING = "<ENVELOPE></ENVELOPE>"
ALL = [n for names, _ in sync.SOURCES.values() for n in names]


def rest(company, stamp, *there):
    """Empty documents of the sections that are not among ``there``."""
    return [(company, n, stamp, NOTHING) for n in ALL if n not in there]


def test_refresh_cycle(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"))
    first = landed(
        spark,
        ("1", "alter_ids", "1", marks(1, 1, 1)), ("1", "ledgers", "1", ledgers(("A", 1), ("B", 2))), ("1", "vouchers", "1", collection(voucher())),
        ("1", "outstanding_receivables", "1", RECEIVABLES), ("1", "outstanding_payables", "1", "<ENVELOPE></ENVELOPE>"), ("1", "profit_loss", "1", PNL),
        *rest("1", "1", "ledgers", "vouchers", "outstanding_receivables", "outstanding_payables", "profit_loss"),
        ("2", "ledgers", "1", ledgers(("A", 7))), ("2", "profit_loss", "1", PNL),
        ("3", "ledgers", "1", ledgers(("A", 7))[:-30]), ("3", "profit_loss", "1", PNL), ("4", "mystery", "1", "<ENVELOPE/>"),
    )
    sync.refresh(store, first, 0, AT)
    state = everything(store)
    assert balances(store) == {("1", "A"): 1, ("1", "B"): 2, ("2", "A"): 7}
    assert store.read("outstanding").count() == 2 and store.read("profit_loss").count() == 10
    log = {r["company_id"]: r for r in sync.status(store).collect()}
    counts = {k: n for k, n in log["1"]["last_records"].items() if n}
    assert counts == {"ledgers": 2, "vouchers": 1, "outstanding": 2, "profit_loss": 5}
    assert log["2"]["last_status"] == "incomplete"
    assert (log["3"]["last_status"], log["3"]["last_error"]) == ("error", "Malformed document")
    assert log["4"]["last_error"] == "Unknown section"

    # The same batch again changes nothing.
    sync.refresh(store, first, 0, AT)
    assert everything(store) == state
    with pytest.raises(ValueError):
        sync.refresh(store, first.limit(1), 0, AT)

    # Company 1 has not changed: skipped whatever is landed. Company 2: an empty report clears, the rest stays.
    second = landed(
        spark, ("1", "alter_ids", "2", marks(1, 1, 1)), ("1", "ledgers", "2", ledgers(("A", 100))),
        ("2", "profit_loss", "2", "<ENVELOPE></ENVELOPE>"), ("2", "ledgers", "2", ledgers(("C", 3))),
    )
    sync.refresh(store, second, 1, AT)
    assert balances(store) == {("1", "A"): 1, ("1", "B"): 2, ("2", "A"): 7, ("2", "C"): 3}
    assert {r["company_id"] for r in store.read("profit_loss").collect()} == {"1"}
    assert {r["company_id"]: r["last_status"] for r in sync.status(store).collect()}["1"] == "success"

    # A rewritten voucher takes its children with it. One half of the bills replaces that half; the markers wait.
    third = landed(
        spark, ("1", "alter_ids", "3", marks(2, 2, 1)), ("1", "vouchers", "3", collection(voucher("5", items=""))),
        ("1", "outstanding_receivables", "3", "<ENVELOPE></ENVELOPE>"), ("1", "ledgers", "3", ledgers(("A", 100))),
    )
    sync.refresh(store, third, 2, AT)
    assert [int(r["amount"]) for r in store.read("vouchers").collect()] == [5]
    assert store.read("voucher_items").count() == 0 and store.read("voucher_ledger_entries").count() == 2
    assert store.read("outstanding").count() == 0
    # Masters did not change, so the ledgers were not asked for.
    assert balances(store)[("1", "A")] == 1
    assert store.read("change_markers").first()["alter_id"] == "1"
    assert {r["company_id"]: r["last_status"] for r in sync.status(store).collect()}["1"] == "incomplete"

    # The rest of the fetch, a batch later and without the markers, completes it.
    sync.refresh(store, landed(spark, *rest("1", "3", "vouchers", "outstanding_receivables")), 3, AT)
    assert store.read("change_markers").first()["alter_id"] == "2"
    assert {r["company_id"]: r["last_status"] for r in sync.status(store).collect()}["1"] == "success"

    # A batch without its commit is not seen.
    store.write("ledgers", spark.createDataFrame([("9", "Z")], "company_id string, name string"), 4)
    assert ("9", "Z") not in {(r["company_id"], r["name"]) for r in store.read("ledgers").collect()}

    state = everything(store)
    assert store.compact(everything=True) == 1
    assert everything(store) == state
    assert len(store.snapshot().parts) == 1


def test_any_cut_into_batches_gives_the_same_state(spark, tmp_path):
    payables = RECEIVABLES.replace("<BILLREF>", "<BILLREF>P")
    fetch = [
        ("1", "alter_ids", "1", marks(1, 1, 1)), ("1", "ledgers", "1", ledgers(("A", 1))), ("1", "ledgers", "1", ledgers(("B", 2))),
        ("1", "outstanding_receivables", "1", RECEIVABLES), ("1", "outstanding_payables", "1", payables),
        ("1", "profit_loss", "1", PNL), ("1", "profit_loss", "1", PNL.replace("20450", "777")), ("1", "vouchers", "1", collection(voucher())),
        *rest("1", "1", "ledgers", "outstanding_receivables", "outstanding_payables", "profit_loss", "vouchers"),
    ]
    whole = LedgerStore(spark, str(tmp_path / "whole"))
    docs = landed(spark, *fetch)
    sync.refresh(whole, docs, 0, AT)
    cut = LedgerStore(spark, str(tmp_path / "cut"))
    for part in range(3):
        sync.refresh(cut, docs.filter(F.pmod(F.xxhash64("path"), F.lit(3)) == part), part, AT)
        if part < 2:
            assert cut.read("change_markers").count() == 0
    assert everything(cut) == everything(whole)
    assert cut.read("outstanding").count() == 4 and cut.read("profit_loss").count() == 10


@pytest.fixture
def few(monkeypatch):
    """Only three tables are asked for, so a fetch is whole with few documents."""
    monkeypatch.setattr(sync, "SOURCES", {t: sync.SOURCES[t] for t in ("ledgers", "vouchers", "profit_loss")})


def content(store):
    found = {t: store.read(t) for t in ("ledgers", "vouchers", "profit_loss", "change_markers")}
    return {t: sorted(map(str, rows.select(sorted(rows.columns)).collect())) for t, rows in found.items()}


def fetch_of(stamp, value, *more):
    """Documents of one fetch, with its manifest."""
    listed = '<SECTION NAME="ledgers" DOCUMENTS="2"/><SECTION NAME="profit_loss" DOCUMENTS="2"/><SECTION NAME="vouchers" DOCUMENTS="1"/>'
    return [
        ("1", "alter_ids", stamp, marks(stamp, stamp, stamp)), ("1", "manifest", stamp, collection(listed)),
        ("1", "ledgers", stamp, ledgers(("A", value), ("B", value))), ("1", "ledgers", stamp, ledgers(("C", value))),
        ("1", "profit_loss", stamp, PNL), ("1", "profit_loss", stamp, PNL.replace("20450", value)),
        ("1", "vouchers", stamp, collection(voucher(value))), *more,
    ]


def state_after(spark, folder, batches):
    store = LedgerStore(spark, str(folder))
    for i, batch in enumerate(batches):
        sync.refresh(store, landed(spark, *batch), i, AT)
    return store


def test_every_document_may_come_late(spark, tmp_path, few):
    """All sections arrive in the first batch, each with one document of two; the rest follows one at a time."""
    docs = fetch_of("1", "7")
    whole = content(state_after(spark, tmp_path / "whole", [docs]))
    assert len(whole["profit_loss"]) == 10 and len(whole["ledgers"]) == 3
    for late in (0, 1, 3, 5, 6):
        store = state_after(spark, tmp_path / f"late{late}", [[d for i, d in enumerate(docs) if i != late], [docs[late]]])
        assert content(store) == whole, late
        statuses = [r["status"] for r in store.read("sync_log").orderBy("batch_id").collect()]
        # Without the manifest one document of each section will do; without its markers the fetch is compared with nothing.
        assert statuses[-1] == "success" and statuses[0] == ("incomplete" if late not in (0, 1) else "success"), late


def test_documents_in_two_batches(spark, tmp_path, few):
    docs = fetch_of("1", "7")
    whole = content(state_after(spark, tmp_path / "whole", [docs]))
    for mask in (0b0000111, 0b1010101, 0b0110100):
        first = [d for i, d in enumerate(docs) if mask >> i & 1]
        second = [d for i, d in enumerate(docs) if not mask >> i & 1]
        assert content(state_after(spark, tmp_path / f"m{mask}", [first, second])) == whole, mask


def test_an_older_fetch_that_lands_later_changes_nothing(spark, tmp_path, few):
    old = fetch_of("1", "11")
    new = fetch_of("2", "22")
    in_order = state_after(spark, tmp_path / "in", [old, new])
    late = state_after(spark, tmp_path / "late", [new, old])
    mixed = state_after(spark, tmp_path / "mixed", [new[:3] + old[4:], old[:4], new[3:]])
    assert [int(r["amount"]) for r in late.read("vouchers").collect()] == [22]
    assert balances(late) == {("1", n): 22 for n in "ABC"}
    assert content(late) == content(in_order) == content(mixed)
    late.compact(everything=True)
    assert content(late) == content(in_order)


def test_markers_are_not_compared_with_those_of_their_own_fetch(spark, tmp_path, few):
    """A fetch whose first part completed by one document per section goes on to take the others."""
    docs = [
        ("1", "alter_ids", "1", marks(1, 1, 1)), ("1", "ledgers", "1", ledgers(("A", 1))), ("1", "profit_loss", "1", PNL),
        ("1", "vouchers", "1", NOTHING),
    ]
    more = [("1", "alter_ids", "1", marks(1, 1, 1)), ("1", "ledgers", "1", ledgers(("B", 2))), ("1", "profit_loss", "1", PNL)]
    store = LedgerStore(spark, str(tmp_path))
    sync.refresh(store, landed(spark, *docs), 0, AT)
    assert store.read("change_markers").count() == 1
    later = landed(spark, *more).withColumn("path", F.concat("path", F.lit("/more")))
    sync.refresh(store, later, 1, AT)
    assert store.read("profit_loss").count() == 10 and balances(store) == {("1", "A"): 1, ("1", "B"): 2}


def test_a_failed_document_hides_its_fetch_only(spark, tmp_path, few):
    good = fetch_of("1", "1")
    bad = fetch_of("2", "2")
    bad[3] = (*bad[3][:3], bad[3][3][:-30])
    store = state_after(spark, tmp_path, [good])
    before = content(store)
    sync.refresh(store, landed(spark, *bad[:3]), 1, AT)
    sync.refresh(store, landed(spark, *bad[3:]), 2, AT)
    assert content(store) == before
    assert sync.status(store).first()["last_status"] == "error"


SNAPSHOT = '<SECTION NAME="ledgers" DOCUMENTS="1" SNAPSHOT="Yes"/>'


def test_a_ledger_that_left_a_full_fetch_leaves_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "SOURCES", {"ledgers": sync.SOURCES["ledgers"]})

    def fetch(stamp, names, manifest):
        docs = [("1", "alter_ids", stamp, marks(stamp, 1, stamp)), ("1", "ledgers", stamp, ledgers(*((n, stamp) for n in names)))]
        return docs + [("1", "manifest", stamp, collection(m)) for m in manifest]

    plain = state_after(spark, tmp_path / "plain", [fetch("1", "AB", []), fetch("2", "BC", [])])
    assert set(balances(plain)) == {("1", n) for n in "ABC"}
    store = state_after(spark, tmp_path / "full", [fetch("1", "AB", []), fetch("2", "BC", [SNAPSHOT])])
    assert balances(store) == {("1", "B"): 2, ("1", "C"): 2}
    late = state_after(spark, tmp_path / "late", [fetch("2", "BC", [SNAPSHOT]), fetch("1", "AB", [])])
    assert balances(late) == balances(store)
    store.compact(everything=True)
    assert balances(store) == {("1", "B"): 2, ("1", "C"): 2}
    assert store.committed("ledgers").count() == 2
    # By the option, for all sections of a whole fetch.
    store = LedgerStore(spark, str(tmp_path / "option"))
    for i, docs in enumerate([fetch("1", "AB", []), fetch("2", "BC", [])]):
        sync.refresh(store, landed(spark, *docs), i, AT, full_snapshot=True)
    assert balances(store) == {("1", "B"): 2, ("1", "C"): 2}


def test_vouchers_vanish_within_the_window_of_their_fetch_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "SOURCES", {"vouchers": sync.SOURCES["vouchers"]})

    def fetch(stamp, last, *vouchers):
        whole = [("1", "vouchers", stamp, collection("".join(vouchers))), ("1", "alter_ids", stamp, marks(stamp, stamp, 1, last))]
        listed = '<SECTION NAME="vouchers" DOCUMENTS="1" SNAPSHOT="Yes"/>'
        info = collection("<COMPANY NAME='One'><BOOKSFROM>20250401</BOOKSFROM><BOOKSTO>20260331</BOOKSTO></COMPANY>")
        return [*whole, ("1", "manifest", stamp, collection(listed)), ("1", "company_info", stamp, info)]

    def one(guid, day, amount="5"):
        return voucher(amount).replace("g1", guid).replace("20250410", day)

    store = state_after(
        spark, tmp_path,
        [fetch("1", "20250601", one("old", "20250410"), one("gone", "20250530"), one("kept", "20250531")), fetch("2", "20250602", one("kept", "20250531", "6"))],
    )
    found = {r["tally_guid"]: int(r["amount"]) for r in store.read("vouchers").collect()}
    assert found == {"old": 5, "kept": 6}


def test_removal_of_a_company(spark, tmp_path):
    def fetch(stamp):
        return [(c, "ledgers", stamp, ledgers(("A", stamp))) for c in "12"] + [(c, "profit_loss", stamp, PNL) for c in "12"]

    store = state_after(spark, tmp_path, [fetch("1")])
    store.remove_companies(spark.createDataFrame([("1",)], "company_id string"), "1")
    for table in ("ledgers", "profit_loss", "companies", "sync_log"):
        assert {r["company_id"] for r in store.read(table).collect()} == {"2"}, table
    sync.refresh(store, landed(spark, *fetch("2")[:1]), 1, AT)
    assert balances(store) == {("1", "A"): 2, ("2", "A"): 1}
    before = content(store)
    store.compact(everything=True)
    assert content(store) == before
    assert {r["company_id"] for r in store.committed("profit_loss").collect()} == {"2"}


def test_parts_grow_with_the_logarithm_of_the_batches(spark, tmp_path, monkeypatch):
    from saldo.plans import store as module

    monkeypatch.setattr(module, "FAN", 2)
    monkeypatch.setattr(module, "KEPT", 1)
    monkeypatch.setattr(sync, "SOURCES", {"ledgers": sync.SOURCES["ledgers"]})
    store = LedgerStore(spark, str(tmp_path))
    for i in range(9):
        names = [("1", "ledgers", str(10 + i), ledgers((f"L{i % 3}", i), ("all", i)))]
        sync.refresh(store, landed(spark, *names), i, AT)
    assert balances(store) == {("1", "all"): 8, ("1", "L0"): 6, ("1", "L1"): 7, ("1", "L2"): 8}
    assert len(store.snapshot().parts) <= 3
    live = {f"part={p.name}" for p in store.snapshot().parts} | {f"part={n}" for n, _ in store.snapshot().retired}
    assert {p.name for p in (tmp_path / "ledgers").iterdir()} <= live
    assert not list((tmp_path / "_staged").iterdir())
    # A batch in a merged part is not run again.
    sync.refresh(store, landed(spark, ("1", "ledgers", "99", ledgers(("X", 1)))), 0, AT)
    assert ("1", "X") not in balances(store)
    with pytest.raises(RuntimeError):
        store._publish(store.snapshot())


def test_vouchers_of_a_window_are_read_by_month(spark, tmp_path):
    rows = [("1", f"g{i}", f"2025-{1 + i % 12:02}-{1 + i % 28:02}", i, "1") for i in range(120)]
    # Moved out of February, and into it.
    rows += [("1", "g1", "2025-05-05", 1000, "2"), ("1", "g2", "2025-02-07", 2000, "2")]
    schema = "company_id string, tally_guid string, date string, amount int, fetched_at string"
    store = LedgerStore(spark, str(tmp_path))
    df = spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))
    store.write("vouchers", df.filter("fetched_at = '1'"), 0)
    store.commit(0)
    store.write("vouchers", df.filter("fetched_at = '2'"), 1)
    store.commit(1)
    window = spark.createDataFrame([("1", "2025-02-05", "2025-03-10")], "company_id string, from_date string, to_date string")
    window = window.select("company_id", F.col("from_date").cast("date"), F.col("to_date").cast("date")).filter("company_id <> ''")
    found = store.vouchers_between(window)
    expected = store.read("vouchers").filter("date BETWEEN '2025-02-05' AND '2025-03-10'").select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    assert {"g1"} & {r["tally_guid"] for r in found.collect()} == set()
    assert "g2" in {r["tally_guid"] for r in found.collect()}
    plan = found._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower() and "month" in plan


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_a_large_export_goes_through_the_refresh_in_ranges(spark, tmp_path, encoding):
    body = "".join(f'<LEDGER NAME="L{i}"><PARENT>P&#4;{i}é</PARENT>\n</LEDGER>' for i in range(3000))
    landing, store = tmp_path / "landing", LedgerStore(spark, str(tmp_path / "store"))
    write(landing, "1", "ledgers", "20250501", collection(body), encoding)
    write(landing, "2", "ledgers", "20250501", collection(body)[:-200], encoding)
    write(landing, "2", "groups", "20250501", collection('<GROUP NAME="G"/>'))
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        start_refresh(
            spark, str(landing), store, str(tmp_path / "checkpoint"), every=None, clock=lambda: AT, row_limit=50_000
        ).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    rows = store.read("ledgers").collect()
    assert sorted((r["company_id"], r["name"], r["group_name"]) for r in rows) == sorted(("1", f"L{i}", f"P{i}é") for i in range(3000))
    assert store.committed("ledgers").select("pos").distinct().count() > 5
    log = {r["company_id"]: (r["status"], r["error_message"]) for r in store.read("sync_log").collect()}
    assert log["2"] == ("error", "Malformed document") and store.read("groups").count() == 0


def test_stock_fallback_is_per_company(spark):
    rows = lambda *r: spark.createDataFrame(r, "company_id string, name string, closing_value decimal(18,2), rate decimal(18,4)")
    from decimal import Decimal

    listed = rows(("1", "sparse", None, None), ("2", "dense", Decimal(5), None), ("3", "sparse", None, None))
    summary = rows(("2", "summary", Decimal(1), None), ("3", "summary", Decimal(2), None), ("4", "summary", Decimal(3), None))
    got = G.dense_or_summary(listed, summary).collect()
    assert sorted((r[0], r[1]) for r in got) == [("1", "sparse"), ("2", "dense"), ("3", "summary"), ("4", "summary")]


def write(root, company, section, stamp, text, encoding="utf-8"):
    folder = Path(root) / f"company={company}" / f"section={section}" / f"fetched_at={stamp}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{company}-{section}-{stamp}.xml").write_bytes(text.encode(encoding))


def test_stream_restarts_from_checkpoint(spark, tmp_path):
    landing, store = tmp_path / "landing", LedgerStore(spark, str(tmp_path / "store"))

    def run():
        start_refresh(spark, str(landing), store, str(tmp_path / "checkpoint"), every=None, clock=lambda: AT).awaitTermination()

    write(landing, "1", "ledgers", "20250501", ledgers(("A", 1)), "utf-16")
    write(landing, "1", "vouchers", "20250501", collection(voucher("1")))
    run()
    run()
    assert balances(store) == {("1", "A"): 1}
    write(landing, "1", "vouchers", "20250508", collection(voucher("2")))
    run()
    assert [int(r["amount"]) for r in store.read("vouchers").collect()] == [2]
    assert len(store.snapshot().parts) == 2


def test_landing_scan_prunes_folders(spark, tmp_path):
    write(tmp_path, "1", "ledgers", "20250501", ledgers(("A", 1)))
    write(tmp_path, "2", "groups", "20250501", collection(""))
    rows = R.read_landing(spark, str(tmp_path)).filter(F.col("section") == "ledgers")
    assert "PartitionFilters: [isnotnull(section" in rows._jdf.queryExecution().toString()
    assert [r["company_id"] for r in rows.collect()] == ["1"]


def test_company_reads_prune_partitions(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path))
    store.write("ledgers", spark.createDataFrame([("1", "A"), ("2", "B")], "company_id string, name string"), 0)
    store.commit(0)
    plan = store.committed("ledgers").filter(F.col("company_id") == "1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(company_id" in plan


def test_large_export_is_split(spark, tmp_path):
    body = "".join(f'<LEDGER NAME="L{i}"><PARENT>P&#4;{i}</PARENT>\n</LEDGER>' for i in range(3000))
    (tmp_path / "big.xml").write_text(collection(body).replace("<LEDGER>0</LEDGER>", ""))
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = read_large_export(spark, str(tmp_path / "big.xml"), X.LEDGERS, "LEDGER")
        assert rows.rdd.getNumPartitions() > 5
        assert {(r["name"], r["group_name"]) for r in rows.collect()} == {(f"L{i}", f"P{i}") for i in range(3000)}
        assert rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)


def test_uncommitted_store_is_empty(spark, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "none"))
    assert store.read("ledgers").count() == 0
    with pytest.raises(KeyError):
        store.write("nothing", spark.range(1), 0)
