"""Skewed groups against brute force, merges, and the seed example."""

from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal as D
import random

import pytest
from pyspark.sql import functions as F

from saldo.operators import aggregates as A, collection as Q, joins as J, merge as G, ordering as O, windows as W
from saldo.operators.skew import paged_lists
from saldo.plans import reads, reports

SEED = [
    ("P-001", "Purchase", "Mill Road Timber", "2025-04-05", "225000"), ("S-001", "Sales", "Harbour Stores", "2025-04-10", "110000"),
    ("P-002", "Purchase", "Ellis Paper", "2025-04-12", "60000"), ("S-002", "Sales", "North Quay Fittings", "2025-04-15", "42500"),
    ("S-003", "Sales", "Harbour Stores", "2025-05-01", "12000"), ("P-003", "Purchase", "Mill Road Timber", "2025-05-02", "16000"),
    ("S-004", "Sales", "North Quay Fittings", "2025-05-20", "18000"), ("S-005", "Sales", "Harbour Stores", "2025-06-05", "55000"),
]
VOUCHER = "company_id string, tally_guid string, voucher_type string, party_name string, date date, amount decimal(18,2)"


def vouchers(spark, rows):
    return spark.createDataFrame([("c", g, t, p, date.fromisoformat(d) if d else None, D(a)) for g, t, p, d, a in rows], VOUCHER)


def test_running_balance_of_the_seed(spark):
    found = W.running_balance(vouchers(spark, SEED)).orderBy("date").collect()
    by_party = defaultdict(list)
    for r in found:
        by_party[r["party_name"]].append(int(r["running_balance"]))
    assert by_party["Harbour Stores"] == [110000, 122000, 177000]
    assert by_party["Mill Road Timber"] == [-225000, -241000]


@pytest.mark.parametrize("chunk", [1, 40, 1000, W.CHUNK])
@pytest.mark.parametrize("step", [2, 64])
def test_running_balance_of_a_hot_party(spark, monkeypatch, chunk, step):
    monkeypatch.setattr(W, "STEP", step)
    rng = random.Random(7)
    rows = []
    for i in range(600):
        party = "hot" if i % 3 else (f"p{i % 17}" if i % 5 else None)
        day = None if i % 50 == 1 else f"2025-0{rng.randint(1, 9)}-{rng.randint(1, 28):02d}"
        rows.append((f"g{i:04d}", rng.choice(["Sales", "Payment", "Debit Note", "Credit Note"]), party, day, str(rng.randint(1, 999))))
    expected, totals = {}, defaultdict(int)
    for g, t, p, d, a in sorted(rows, key=lambda r: (r[3] is None, r[3] or "", r[0])):
        totals[p] += int(a) if t in ("Sales", "Debit Note") else -int(a)
        expected[g] = totals[p]
    found = W.running_balance(vouchers(spark, rows), chunk=chunk).collect()
    assert len(found) == 600
    assert {r["tally_guid"]: int(r["running_balance"]) for r in found} == expected


@pytest.mark.parametrize("few", [0, W.BROADCAST])
def test_one_party_on_one_day_spreads_over_tasks(spark, monkeypatch, few):
    """All guids begin alike, so only their rank tells them apart."""
    monkeypatch.setattr(W, "BROADCAST", few)
    rows = [(f"the-same-beginning-{i:06d}", "Sales", "P", "2025-04-01", 1) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = W.running_balance(vouchers(spark, rows), chunk=200)
        tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 3000
    assert {int(r["running_balance"]) for r in found.collect()} == set(range(1, 4001))


def test_pages_by_position_keep_every_copy(spark):
    rows = [("hot", i, "same") for i in range(500)] + [("hot", 500 + i, f"x{i}") for i in range(100)] + [("a", 0, "1"), ("a", 1, "2")]
    df = spark.createDataFrame(rows, "k string, line int, v string")
    pages = paged_lists(df, ["k"], F.struct("v"), "vs", page_rows=50).collect()
    bag = Counter((r["k"], e["v"]) for r in pages for e in r["vs"])
    assert bag == Counter((k, v) for k, _, v in rows)
    assert sorted((r["k"], r["page"], len(r["vs"])) for r in pages) == [("a", 0, 2)] + [("hot", i, 50) for i in range(12)]
    whole = paged_lists(df, ["k"], F.struct("v"), "vs", page_rows=None).collect()
    assert sorted((r["k"], r["page"], len(r["vs"])) for r in whole) == [("a", 0, 2), ("hot", 0, 600)]


def test_nested_items(spark):
    headers = vouchers(spark, SEED[:2])
    rows = [("c", "S-001", 0, "b", 1), ("c", "S-001", 1, "a", 2)]
    items = spark.createDataFrame(rows, "company_id string, tally_guid string, line int, name string, n int")
    found = {r["tally_guid"]: [tuple(i) for i in r["items"]] for r in J.vouchers_with_items(headers, items).collect()}
    assert found == {"P-001": [], "S-001": [("a", 2), ("b", 1)]}
    paged = J.vouchers_with_items(headers, items, page_rows=1).collect()
    assert sorted((r["tally_guid"], r["item_page"], len(r["items"])) for r in paged) == [("P-001", 0, 0), ("S-001", 0, 1), ("S-001", 1, 1)]


def test_company_lookup(spark):
    companies = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "B")], "company_id string, name string")
    assert J.company_id_of(companies, "A") == "1"
    for name in ("B", "C"):
        with pytest.raises(J.CompanyNotFound):
            J.company_id_of(companies, name)


def table(spark, rows, columns="k string, a string, b int"):
    return spark.createDataFrame(rows, columns)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_upsert(spark):
    old = table(spark, [("x", "old", 1), ("y", "old", 2)])
    new = table(spark, [("y", "new", 3), ("z", "new", None)])
    once = G.upsert(old, new, ["k"])
    assert as_set(once) == {("x", "old", 1), ("y", "new", 3), ("z", "new", None)}
    assert as_set(G.upsert(once, new, ["k"])) == as_set(once)
    partial = G.upsert(old, new.select("k", "a"), ["k"])
    assert as_set(partial) == {("x", "old", 1), ("y", "new", 2), ("z", "new", None)}
    cleared = G.upsert(old, table(spark, [("y", None)], "k string, a string"), ["k"])
    assert as_set(cleared) == {("x", "old", 1), ("y", None, 2)}
    twice = table(spark, [("y", "first", 1), ("y", "last", 2)])
    assert as_set(G.upsert(old, twice, ["k"], [F.col("b").desc()])) == {("x", "old", 1), ("y", "last", 2)}


def test_full_snapshot_drops_vanished_rows(spark):
    columns = "company_id string, k string, a int"
    old = table(spark, [("1", "x", 1), ("1", "y", 1), ("2", "x", 1)], columns)
    new = table(spark, [("1", "x", 2)], columns)
    whole = spark.createDataFrame([("1",)], "company_id string")
    assert as_set(G.upsert(old, new, ["company_id", "k"], full_snapshot=whole)) == {("1", "x", 2), ("2", "x", 1)}


def test_replace_section_tells_empty_from_missing(spark):
    columns = "company_id string, v int"
    old = table(spark, [("1", 1), ("2", 2), ("3", 3)], columns)
    new = table(spark, [("1", 9)], columns)
    provided = spark.createDataFrame([("1",), ("2",)], "company_id string")
    assert as_set(G.replace_section(old, new, provided)) == {("1", 9), ("3", 3)}


def test_stock_fallback(spark):
    columns = "company_id string, closing_value int, rate int"
    stock = table(spark, [("1", 0, 0), ("1", 0, 2), ("2", 0, 0)], columns)
    summary = table(spark, [("1", 7, 7), ("2", 8, 8)], columns)
    assert as_set(G.dense_or_summary(stock, summary)) == {("1", 0, 0), ("1", 0, 2), ("2", 8, 8)}


def test_party_ledger(spark):
    headers = vouchers(spark, SEED).withColumn("voucher_number", F.col("tally_guid")).withColumn("narration", F.lit(""))
    ledgers = table(spark, [("c", "Harbour Stores", "Sundry Debtors", 75000), ("c", "Mill Road Timber", "Sundry Creditors", -40000),
                            ("c", "Twin", "Sundry Debtors", 1), ("c", "Twin", "Sundry Debtors", 2), ("c", "River Bank", "Bank Accounts", 3)],
                    "company_id string, name string, group_name string, closing_balance int")
    bills = table(spark, [("c", "Harbour Stores", "receivable", 10, 5), ("c", "Harbour Stores", "payable", -4, 95)],
                  "company_id string, party_name string, type string, pending_amount int, days_overdue int")
    items = table(spark, [("c", "S-001", 0, "Drill")], "company_id string, tally_guid string, line int, stock_item_name string")
    one = reads.party_ledger(ledgers, bills, headers, items, "c", "Harbour Stores")
    profile = one.profile.collect()
    assert len(profile) == 1
    assert (profile[0]["total_outstanding"], profile[0]["total_transactions"], profile[0]["closing_balance"]) == (D("14.00"), 3, 75000)
    assert [(r["tally_guid"], len(r["items"]), int(r["running_balance"])) for r in one.transactions.collect()] == [
        ("S-001", 1, 110000), ("S-003", 0, 122000), ("S-005", 0, 177000),
    ]
    everyone = reads.party_ledger(ledgers, bills, headers, items)
    found = {r["party_name"]: r for r in everyone.profile.collect()}
    assert found["Ellis Paper"]["has_ledger"] is False and "Twin" not in found
    parties = reads.parties(ledgers, bills)
    assert sorted((r["name"], r["type"], r["total_outstanding"]) for r in parties.collect()) == [
        ("Harbour Stores", "customer", D("14.00")), ("Mill Road Timber", "supplier", D("0.00")), ("Twin", "customer", D("0.00")), ("Twin", "customer", D("0.00"))]


def test_null_placement(spark):
    rows = vouchers(spark, [("a", "Sales", "p", None, "1"), ("b", "Sales", "p", "2025-01-01", "1"), ("c", "Sales", "p", "2025-01-02", "1")])
    order = lambda df: [r["tally_guid"] for r in df.collect()]
    assert order(O.newest_first(rows)) == ["a", "c", "b"]
    assert order(O.oldest_first(rows)) == ["b", "c", "a"]
    assert order(O.recent(rows, 2)) == ["c", "b"]


def test_period_statistics_overlap(spark):
    found = Q.period_statistics(vouchers(spark, SEED), [("2025-04-01", "2025-04-30"), ("2025-04-10", "2025-05-01")])
    assert {(str(r["from_date"]), r["voucher_type"]): r["records"] for r in found.collect()} == {
        ("2025-04-01", "Sales"): 2, ("2025-04-01", "Purchase"): 2, ("2025-04-10", "Sales"): 3, ("2025-04-10", "Purchase"): 1}


def test_group_rollup(spark):
    groups = table(spark, [("1", "Assets", ""), ("1", "Debtors", "Assets"), ("1", "North", "Debtors"), ("2", "Assets", "")], "company_id string, name string, parent string")
    ledgers = table(spark, [("1", "North", 5), ("1", "Debtors", 2), ("2", "Assets", 9), ("1", "North", 1)], "company_id string, group_name string, closing_balance int")
    found = {(r["company_id"], r["name"]): int(r["balance"]) for r in reports.group_rollup(spark, groups, ledgers).collect()}
    assert found == {("1", "North"): 6, ("1", "Debtors"): 8, ("1", "Assets"): 8, ("2", "Assets"): 9}


def test_group_rollup_of_a_deep_chain_and_of_a_circle(spark):
    chain = [("1", f"g{i}", f"g{i - 1}" if i else "") for i in range(5000)] + [("2", f"g{i}", f"g{i // 3}" if i else None) for i in range(300)]
    groups = table(spark, chain, "company_id string, name string, parent string")
    own = [(c, n, i % 7) for i, (c, n, _) in enumerate(chain) if i % 2] + [("1", "nowhere", 3), ("1", "g4999", 1)]
    ledgers = table(spark, own, "company_id string, group_name string, closing_balance int")
    expected = defaultdict(int)
    parent = {(c, n): p for c, n, p in chain}
    for c, n, amount in own:
        while n:
            expected[c, n] += amount
            n = parent.get((c, n))
    found = reports.group_rollup(spark, groups, ledgers).collect()
    assert {(r["company_id"], r["name"]): int(r["balance"]) for r in found} == expected
    circle = groups.unionByName(table(spark, [("3", "a", "b"), ("3", "b", "c"), ("3", "c", "a"), ("3", "d", "a")], "company_id string, name string, parent string"))
    with pytest.raises(reports.GroupCycle, match="of '3'"):
        reports.group_rollup(spark, circle, ledgers)


def test_group_rollup_without_rows(spark):
    groups = table(spark, [("1", "Debtors", "Assets")], "company_id string, name string, parent string")
    ledgers = table(spark, [("1", "Debtors", 5)], "company_id string, group_name string, closing_balance int")
    assert reports.group_rollup(spark, groups, ledgers.limit(0)).collect() == []
    assert reports.group_rollup(spark, groups.limit(0), ledgers).collect() == [("1", "Debtors", D("5.00"))]
    assert as_set(reports.group_rollup(spark, groups, ledgers)) == {("1", "Debtors", D("5.00")), ("1", "Assets", D("5.00"))}


def test_balance_invariants(spark):
    rows = vouchers(spark, SEED)
    last = W.running_balance(rows).groupBy("party_name").agg(F.max_by("running_balance", F.struct("date", "tally_guid")).alias("b"))
    total = W.running_balance(rows).agg(F.sum("signed_amount")).first()[0]
    assert last.agg(F.sum("b")).first()[0] == total
    kpis = A.dashboard_kpis(rows, table(spark, [("c", "p", "receivable", -5)], "company_id string, party_name string, type string, pending_amount int"),
                            table(spark, [("d", 7)], "company_id string, closing_value int"), "2025-04-10")
    assert {r["company_id"]: [int(r[k]) for k in A.KPIS] for r in kpis.collect()} == {"c": [110000, 0, 5, 0, 0], "d": [0, 0, 0, 0, 7]}
