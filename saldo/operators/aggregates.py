"""Totals and counts. All sums are decimal, so that order and partitioning do not show in the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saldo.functions import scalars as S

TOTAL = "decimal(28,2)"


def size_of(amount) -> Column:
    return F.abs(F.coalesce(S.col(amount), F.lit(0)))


def total(amount, when: Column | None = None) -> Column:
    """Sum of absolute amounts, 0 for no rows."""
    value = size_of(amount) if when is None else F.when(when, size_of(amount))
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def outstanding_by_party(outstanding: DataFrame) -> DataFrame:
    """Receivable and payable are added together, as the party list shows them."""
    return outstanding.groupBy("company_id", "party_name").agg(
        total("pending_amount").alias("total_outstanding")
    )


def party_outstanding_total(outstanding: DataFrame) -> DataFrame:
    return outstanding.agg(total("pending_amount").alias("total_outstanding"))


def record_counts(sections: dict[str, DataFrame | None], keys: list[str]) -> DataFrame:
    """Rows per provided section as one map per key; a section that was not fetched (None) is left out."""
    counts = None
    for name, rows in sections.items():
        if rows is None:
            continue
        part = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    entry = F.struct("section", "n")
    return counts.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("records")
    )


def day_total(vouchers: DataFrame, kind: str, day: str, name: str = "total") -> DataFrame:
    on_day = (F.col("voucher_type") == kind) & (F.col("date") == F.lit(day).cast("date"))
    return vouchers.agg(total("amount", on_day).alias(name))


def outstanding_total(outstanding: DataFrame, keys: list[str] = ()) -> DataFrame:
    return outstanding.groupBy(*keys).agg(
        total("pending_amount", F.col("type") == "receivable").alias("total_receivable"),
        total("pending_amount", F.col("type") == "payable").alias("total_payable"),
    )


def stock_value(stock: DataFrame, keys: list[str] = ()) -> DataFrame:
    return stock.groupBy(*keys).agg(
        total("closing_value").alias("stock_value"), F.count(F.lit(1)).alias("item_count")
    )


KPIS = ("today_sales", "today_purchases", "total_receivable", "total_payable", "stock_value")


def dashboard_kpis(vouchers: DataFrame, outstanding: DataFrame, stock: DataFrame, day: str) -> DataFrame:
    """The five headline figures per company: each table is reduced first, the few rows are then added up."""
    key = ["company_id"]
    today = F.col("date") == F.lit(day).cast("date")
    parts = (
        vouchers.filter(today & F.col("voucher_type").isin("Sales", "Purchase")).groupBy(*key).agg(
            total("amount", F.col("voucher_type") == "Sales").alias("today_sales"),
            total("amount", F.col("voucher_type") == "Purchase").alias("today_purchases"),
        ),
        outstanding_total(outstanding, key),
        stock_value(stock, key).drop("item_count"),
    )
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined.groupBy(*key).agg(
        *(F.coalesce(F.sum(k), F.lit(0)).cast(TOTAL).alias(k) for k in KPIS)
    )


def voucher_type_totals(vouchers: DataFrame) -> DataFrame:
    """Count and total of every type and of all types (``All``) in one pass."""
    return (
        vouchers.rollup("voucher_type")
        .agg(
            F.grouping("voucher_type").alias("is_all"),
            F.count(F.lit(1)).alias("entries"),
            total("amount").alias("total"),
        )
        .select(
            F.when(F.col("is_all") == 1, "All").otherwise(F.col("voucher_type")).alias("voucher_type"),
            "entries",
            "total",
        )
    )


def items_per_voucher(items: DataFrame) -> DataFrame:
    return items.groupBy("company_id", "tally_guid").agg(F.count(F.lit(1)).alias("item_count"))


def party_counts(parties: DataFrame, keys: list[str] = ()) -> DataFrame:
    return parties.groupBy(*keys, S.party_type("group_name").alias("type")).agg(
        F.count(F.lit(1)).alias("parties")
    )


def pnl_totals(profit_loss: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Totals of the main rows; sub rows only break those down and would count twice."""
    main = F.col("level") == "main"
    return (
        profit_loss.groupBy(*keys)
        .agg(
            total("amount", main & F.col("is_income")).alias("income"),
            total("amount", main & ~F.col("is_income")).alias("expenses"),
        )
        .withColumn("profit", (F.col("income") - F.col("expenses")).cast(TOTAL))
        .withColumn("label", S.pnl_label("profit"))
    )


def balance_totals(balance_sheet: DataFrame, keys: list[str] = ()) -> DataFrame:
    return balance_sheet.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("side") == "asset", F.col("amount"))), F.lit(0)).cast(TOTAL).alias("total_assets"),
        F.coalesce(F.sum(F.when(F.col("side") == "liability", F.col("amount"))), F.lit(0))
        .cast(TOTAL)
        .alias("total_liabilities"),
    )


def any_metric(stock: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any item carries a value or a rate; without one the section is sparse."""
    carries = (F.coalesce("closing_value", F.lit(0)) != 0) | (F.coalesce("rate", F.lit(0)) != 0)
    return stock.groupBy(*keys).agg(F.bool_or(carries).alias("has_metrics"))


def trial_check(trial_balance: DataFrame, keys: list[str] = ()) -> DataFrame:
    sums = trial_balance.groupBy(*keys).agg(
        F.sum("debit").cast(TOTAL).alias("debit_total"), F.sum("credit").cast(TOTAL).alias("credit_total")
    )
    return sums.withColumn("balanced", F.col("debit_total") == F.col("credit_total"))
