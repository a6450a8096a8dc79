from datetime import date, datetime

import pytest

from saldo.operators import changes as C

MARK = "company_id string, alter_id string, alt_vch_id string, vch_id string, alt_mst_id string, last_voucher_date date"
FY = date(2025, 4, 1)


def mark(text):
    if text is None:
        return []
    *ids, last = text.split(",")
    return [("c", *ids, date.fromisoformat(last) if last else None)]


@pytest.mark.parametrize(
    "cached,current,mode,start,needs,reason",
    [
        ("1,1,1,1,2025-05-01", None, "full", FY, "gvso", "missing_change_markers"),
        (None, "1,1,1,1,2025-05-01", "full", FY, "gvso", "first_successful_sync"),
        (None, None, "full", FY, "gvso", "missing_change_markers"),
        ("1,1,1,1,2025-05-01", "1,1,1,1,2025-05-01", "skipped", None, "", "no_changes"),
        ("1,1,1,1,2025-05-01", "2,2,1,1,2025-05-20", "incremental", date(2025, 4, 24), "vso", "changes_detected"),
        ("1,1,1,1,2025-05-01", "2,2,1,1,2025-05-01", "full", FY, "vso", "changes_detected"),
        ("1,1,1,1,2025-04-03", "2,2,2,1,2025-04-09", "incremental", FY, "vso", "changes_detected"),
        ("1,1,1,1,2025-05-01", "2,1,1,2,2025-05-01", "none", FY, "gs", "changes_detected"),
        ("1,1,1,1,2025-05-01", "2,1,1,1,2025-05-01", "none", FY, "gs", "changes_detected"),
        ("1,1,1,1,", "1,2,1,1,2025-05-20", "full", FY, "vso", "changes_detected"),
    ],
)
def test_sync_plan(spark, cached, current, mode, start, needs, reason):
    companies = spark.createDataFrame([("c", FY, date(2026, 3, 31))], "company_id string, fy_from date, fy_to date")
    row = C.sync_plan(companies, spark.createDataFrame(mark(current), MARK), spark.createDataFrame(mark(cached), MARK)).first()
    assert (row["voucher_sync_mode"], row["voucher_from_date"], row["reason"]) == (mode, start, reason)
    flags = {"g": ("need_groups", "need_ledgers"), "v": ("need_vouchers",), "s": ("need_stock",), "o": ("need_outstanding", "need_reports")}
    for letter, names in flags.items():
        for name in names:
            assert row[name] == (letter in needs), name
    assert row["has_changes"] == (mode != "skipped")


def test_latest_status(spark):
    log = spark.createDataFrame(
        [("a", datetime(2025, 1, 1), "success", {"v": 3}, None), ("a", datetime(2025, 1, 2), "skipped", None, None),
         ("b", datetime(2025, 1, 1), "success", {"v": 5}, None), ("b", datetime(2025, 1, 3), "error", None, "bad")],
        "company_id string, synced_at timestamp, status string, records map<string,int>, error_message string",
    )
    found = {r["company_id"]: r for r in C.latest_status(log).collect()}
    assert (found["a"]["last_status"], found["a"]["last_records"], found["a"]["last_synced_at"]) == ("success", {"v": 3}, datetime(2025, 1, 2))
    assert (found["b"]["last_status"], found["b"]["last_records"], found["b"]["last_error"]) == ("error", {"v": 5}, "bad")
