"""The served read queries, composed from the operators. Each takes the ledger tables and returns DataFrames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from saldo.functions import scalars as S
from saldo.operators import aggregates as A, filters as P, joins as J, ordering as O, windows as W


class PartyLedger(NamedTuple):
    """Profile rows (ledger, outstanding total, transaction count), open bills and transactions."""

    profile: DataFrame
    bills: DataFrame
    transactions: DataFrame


def party_ledger(
    ledgers: DataFrame,
    outstanding: DataFrame,
    vouchers: DataFrame,
    items: DataFrame,
    company_id: str | None = None,
    party: str | None = None,
) -> PartyLedger:
    """Account of one party, or with no arguments of every party of every company in one plan."""
    if company_id is not None:
        ledgers, outstanding, vouchers, items = (
            P.of_company(t, company_id) for t in (ledgers, outstanding, vouchers, items)
        )
    if party is not None:
        ledgers = P.of_party(ledgers, party, "name")
        outstanding, vouchers = P.of_party(outstanding, party), P.of_party(vouchers, party)
        items = items.join(vouchers.select(*J.VOUCHER), J.VOUCHER, "left_semi")

    found = J.party_profile(ledgers, outstanding, vouchers)
    key = ["company_id", "party_name"]
    totals = A.outstanding_by_party(found.bills)
    counts = found.vouchers.groupBy(*key).agg(F.count(F.lit(1)).alias("total_transactions"))
    profile = (
        found.ledgers.withColumn("has_ledger", F.lit(True))
        .join(totals, key, "full_outer")
        .join(counts, key, "full_outer")
        .withColumn("has_ledger", F.coalesce("has_ledger", F.lit(False)))
        .withColumn("total_outstanding", F.coalesce("total_outstanding", F.lit(0)).cast(A.TOTAL))
        .withColumn("total_transactions", F.coalesce("total_transactions", F.lit(0).cast("bigint")))
    )
    transactions = J.vouchers_with_items(W.running_balance(found.vouchers), items).select(
        "company_id", "party_name", "tally_guid", "date", "voucher_type", "voucher_number", "amount",
        "narration", "items", "item_page", "running_balance",
    )
    if party is not None:
        transactions = O.oldest_first(transactions)
    return PartyLedger(profile, found.bills, transactions)


def parties(ledgers: DataFrame, outstanding: DataFrame) -> DataFrame:
    return J.parties_with_outstanding(P.parties(ledgers), outstanding).select(
        "company_id",
        "name",
        F.col("group_name").alias("group"),
        S.party_type("group_name").alias("type"),
        "closing_balance",
        "total_outstanding",
    )


def vouchers(headers: DataFrame, items: DataFrame) -> DataFrame:
    return O.newest_first(J.vouchers_with_items(headers, items))


def outstanding(bills: DataFrame) -> DataFrame:
    return O.most_overdue_first(bills)


class Dashboard(NamedTuple):
    kpis: DataFrame
    recent: DataFrame


def dashboard(headers: DataFrame, bills: DataFrame, stock: DataFrame, day: str) -> Dashboard:
    return Dashboard(A.dashboard_kpis(headers, bills, stock, day), O.recent(headers))


class ListView(NamedTuple):
    rows: DataFrame
    totals: DataFrame


def sales_view(headers: DataFrame, items: DataFrame, kind: str = "All") -> ListView:
    chosen = P.of_voucher_type(headers, kind)
    shown = J.vouchers_with_item_counts(chosen, items).withColumn(
        "shown_amount", S.format_inr("amount")
    )
    for c in ("voucher_number", "party_name"):
        shown = shown.withColumn(c, S.dash_if_empty(c))
    return ListView(
        shown, chosen.agg(F.count(F.lit(1)).alias("entries"), A.total("amount").alias("total"))
    )


def outstanding_view(bills: DataFrame, kind: str) -> ListView:
    chosen = P.of_outstanding_type(bills, kind)
    shown = (
        chosen.withColumn("days_overdue", F.coalesce("days_overdue", F.lit(0)))
        .withColumn("bucket", S.aging_bucket("days_overdue"))
        .withColumn("shown_amount", S.format_inr("pending_amount"))
    )
    for c in ("voucher_number", "voucher_date", "due_date"):
        shown = shown.withColumn(c, S.dash_if_empty(c))
    return ListView(shown, chosen.agg(A.total("pending_amount").alias("total")))


def inventory_view(stock: DataFrame) -> ListView:
    shown = (
        stock.withColumn("unit", S.default_if_empty("unit", "Nos"))
        .withColumn("status", S.stock_status("closing_qty"))
        .withColumn("shown_rate", F.when(F.coalesce("rate", F.lit(0)) != 0, S.format_inr("rate")).otherwise("—"))
        .withColumn("shown_value", S.format_inr("closing_value"))
    )
    return ListView(shown, A.stock_value(stock))


def parties_view(ledgers: DataFrame, bills: DataFrame, kind: str) -> ListView:
    chosen = P.of_party_type(parties(ledgers, bills), kind)
    owed = F.col("total_outstanding")
    shown = chosen.withColumn("shown_outstanding", F.when(owed > 0, S.format_inr(owed)).otherwise("—"))
    return ListView(shown, chosen.agg(F.count(F.lit(1)).alias("parties")))


def pnl_view(profit_loss: DataFrame) -> ListView:
    """Rows by section (a row of 0 belongs to neither) and the totals per company."""
    section = F.when(F.col("raw_amount") > 0, "Income").when(F.col("raw_amount") < 0, "Expenses")
    rows = profit_loss.withColumn("section", section).withColumn("shown_amount", S.format_inr("amount"))
    return ListView(rows, A.pnl_totals(profit_loss, ["company_id"]))


def balance_view(balance_sheet: DataFrame) -> ListView:
    section = F.when(F.col("side") == "asset", "Assets").otherwise("Liabilities")
    rows = balance_sheet.withColumn("section", section).withColumn("shown_amount", S.format_inr("amount"))
    return ListView(rows, A.balance_totals(balance_sheet, ["company_id"]))


def trial_balance(rows: DataFrame) -> ListView:
    return ListView(rows, A.trial_check(rows, ["company_id"]))


def alter_ids(markers: DataFrame, company_id: str) -> DataFrame:
    return P.of_company(markers, company_id).select("alter_id", "alt_vch_id", "alt_mst_id")
