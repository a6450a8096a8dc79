"""Change detection from per-company markers, and what a refresh has to cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saldo.functions import scalars as S

# Fixed values.
OVERLAP_DAYS = 7
MARKERS = ("alter_id", "alt_vch_id", "vch_id", "alt_mst_id", "last_voucher_date")


def incremental_start(fy_from, cached_last, days: int = OVERLAP_DAYS) -> Column:
    """First day to read again: the overlap before the last known voucher, not before the year starts."""
    return F.greatest(S.col(fy_from), F.date_sub(S.col(cached_last), days))


def decide(now: Column, before: Column, fy_from: Column, fy_to: Column) -> dict[str, Column]:
    """What changed between two structs of markers, and what to fetch; without either of them everything.

    Columns by name, in the order of a plan's columns.
    """

    def differs(marker: str) -> Column:
        return F.coalesce(now[marker], F.lit("0")) != F.coalesce(before[marker], F.lit("0"))

    everything = now.isNull() | before.isNull()
    company = everything | differs("alter_id")
    moved = differs("alt_vch_id") | differs("vch_id")
    voucher = everything | moved
    master = everything | differs("alt_mst_id") | (differs("alter_id") & ~moved)
    changed = company | voucher | master
    cached_last, current_last = before["last_voucher_date"], now["last_voucher_date"]
    advanced = F.coalesce(~everything & voucher & (current_last > cached_last), F.lit(False)) & fy_from.isNotNull()
    start = F.when(advanced, incremental_start(fy_from, cached_last)).otherwise(fy_from)
    return {
        "has_changes": changed,
        "master_changed": master,
        "voucher_changed": voucher,
        "need_groups": master,
        "need_ledgers": master,
        "need_vouchers": voucher,
        "need_stock": master | voucher,
        "need_outstanding": voucher,
        "need_reports": voucher,
        "voucher_from_date": F.when(changed, start),
        "voucher_to_date": F.when(changed, fy_to),
        "voucher_sync_mode": F.when(~changed, "skipped").when(advanced, "incremental").when(voucher, "full").otherwise("none"),
        "reason": F.when(now.isNull(), "missing_change_markers")
        .when(before.isNull(), "first_successful_sync")
        .when(~changed, "no_changes")
        .otherwise("changes_detected"),
    }


def sync_plan(companies: DataFrame, current: DataFrame, cached: DataFrame) -> DataFrame:
    """One row per company of ``companies(company_id, fy_from, fy_to)``: what changed and what to fetch.

    ``current`` and ``cached`` hold the markers by company; a company missing from either is fetched in full.
    """
    now = current.select("company_id", F.struct(*MARKERS).alias("current"))
    before = cached.select("company_id", F.struct(*MARKERS).alias("cached"))
    rows = companies.join(now, "company_id", "left").join(before, "company_id", "left")
    plan = decide(F.col("current"), F.col("cached"), F.col("fy_from"), F.col("fy_to"))
    return rows.select("company_id", *(value.alias(name) for name, value in plan.items()))


def incremental_rows(vouchers: DataFrame, plan: DataFrame) -> DataFrame:
    """Vouchers a refresh reads again: those of companies that need them, within the planned dates."""
    wanted = plan.filter("need_vouchers").select("company_id", "voucher_from_date", "voucher_to_date")
    return (
        vouchers.join(wanted, "company_id")
        .filter(F.col("date").between(F.col("voucher_from_date"), F.col("voucher_to_date")))
        .drop("voucher_from_date", "voucher_to_date")
    )


def with_changes(rows: DataFrame, plan: DataFrame, flag: str = "has_changes") -> DataFrame:
    """Rows of the companies whose plan sets ``flag``; for the others nothing is done."""
    return rows.join(plan.filter(F.col(flag)).select("company_id"), "company_id", "left_semi")


def next_markers(cached: DataFrame, current: DataFrame, pushed: DataFrame) -> DataFrame:
    """Markers after a refresh: the current ones of companies that were written, else the cached ones."""
    done = current.join(pushed.select("company_id"), "company_id", "left_semi")
    return cached.join(done, "company_id", "left_anti").unionByName(done)


def latest_status(sync_log: DataFrame) -> DataFrame:
    """Per company the last status, time, error and counts; a skipped run counts as success.

    A run that is still incomplete has no time of success.

    Counts come from the last run that reported any, since failed and skipped runs leave them as they were.
    """
    order = F.struct("synced_at", "seq") if "seq" in sync_log.columns else F.struct("synced_at")
    wrote = F.col("status") == "success"
    done = F.col("status").isin("success", "skipped")
    return sync_log.groupBy("company_id").agg(
        F.when(F.max_by("status", order).isin("error", "incomplete"), F.max_by("status", order))
        .otherwise("success")
        .alias("last_status"),
        F.max(F.when(done, F.col("synced_at"))).alias("last_synced_at"),
        F.max_by("error_message", order).alias("last_error"),
        F.max_by(F.when(wrote, F.col("records")), F.when(wrote, order)).alias("last_records"),
    )
