"""Further reports over the ledger tables, beyond the served reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from saldo.operators.aggregates import TOTAL, total
from saldo.session import new_folder

# Fixed values.
INWARD = ("Purchase", "Receipt", "Debit Note")
OUTWARD = ("Sales", "Payment")
CASH_GROUPS = ("Cash-in-Hand", "Bank Accounts")


def aging_totals(outstanding: DataFrame) -> DataFrame:
    days = F.coalesce("days_overdue", F.lit(0))
    bucket = F.when(days > 60, "60+").when(days > 30, "30-60").otherwise("0-30")
    return outstanding.groupBy("company_id", "type", bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("bills"), total("pending_amount").alias("total")
    )


def sales_breakdown(vouchers: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Sales by ``day``, ``month`` or ``party`` within a date range, ends included."""
    sales = vouchers.filter(
        (F.col("voucher_type") == "Sales")
        & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    key = {"day": F.col("date").cast("string"), "month": F.date_format("date", "yyyy-MM"), "party": F.col("party_name")}[by]
    return sales.groupBy("company_id", key.alias(by)).agg(
        F.count(F.lit(1)).alias("entries"), total("amount").alias("total")
    )


def item_sales(vouchers: DataFrame, items: DataFrame) -> DataFrame:
    """Quantity and amount sold per item: the sales first, one join, one aggregation."""
    key = ["company_id", "tally_guid"]
    sales = vouchers.filter(F.col("voucher_type") == "Sales").select(*key)
    return items.join(sales, key, "left_semi").groupBy("company_id", "stock_item_name").agg(
        F.sum("quantity").alias("quantity"), F.sum(F.abs("amount")).cast(TOTAL).alias("amount")
    )


def best_sellers(vouchers: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    return item_sales(vouchers, items).orderBy(F.col("amount").desc(), "company_id", "stock_item_name").limit(n)


def item_movement(vouchers: DataFrame, items: DataFrame) -> DataFrame:
    key = ["company_id", "tally_guid"]
    typed = items.join(vouchers.select(*key, "voucher_type"), key)
    zero = F.lit(0)
    return typed.groupBy("company_id", "stock_item_name").agg(
        F.coalesce(F.sum(F.when(F.col("voucher_type").isin(*INWARD), F.col("quantity"))), zero).alias("qty_in"),
        F.coalesce(F.sum(F.when(F.col("voucher_type").isin(*OUTWARD), F.col("quantity"))), zero).alias("qty_out"),
    )


def low_stock(stock: DataFrame, threshold) -> DataFrame:
    return stock.filter(F.col("closing_qty") <= F.lit(threshold))


def cash_bank(ledgers: DataFrame) -> DataFrame:
    chosen = ledgers.filter(F.col("group_name").isin(*CASH_GROUPS))
    return chosen.groupBy("company_id", "group_name").agg(
        F.sum("closing_balance").cast(TOTAL).alias("balance"), F.count(F.lit(1)).alias("ledgers")
    )


def cash_flow(vouchers: DataFrame) -> DataFrame:
    flows = vouchers.filter(F.col("voucher_type").isin("Receipt", "Payment"))
    return (
        flows.groupBy("company_id", F.date_format("date", "yyyy-MM").alias("month"))
        .agg(
            total("amount", F.col("voucher_type") == "Receipt").alias("receipts"),
            total("amount", F.col("voucher_type") == "Payment").alias("payments"),
        )
        .withColumn("net", (F.col("receipts") - F.col("payments")).cast(TOTAL))
    )


class GroupCycle(ValueError):
    """Groups that are their own ancestors."""


def group_rollup(spark: SparkSession, groups: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Closing balances of every group with those of the groups below it, of any depth.

    Ledgers are reduced to one row per group first. Then pointers are doubled: in round k every group knows its ancestor 2^k
    levels up and the sum of what lies less than 2^k levels below it; the sums of the groups whose pointer leads to it are
    exactly those of the next 2^k levels. So a tree of depth d takes about log2(d) rounds of one join and one aggregation
    over the groups, each written to the shared folder. Pointers that still lead somewhere after as many rounds as there
    could be levels are going round: that is an error which names some of the groups.

    A balance whose group has no row counts for that group's name alone; groups without a ledger below them are left out.
    """
    key = ["company_id", "name"]
    own = ledgers.groupBy("company_id", F.col("group_name").alias("name")).agg(
        F.sum("closing_balance").cast(TOTAL).alias("balance"), F.count(F.lit(1)).alias("ledgers")
    )
    parents = groups.groupBy(*key).agg(F.max(F.nullif("parent", F.lit(""))).alias("up"))
    # Parents that have no row themselves are groups too.
    named = parents.filter("up IS NOT NULL").select("company_id", F.col("up").alias("name"), F.lit(None).cast("string").alias("up"))
    parents = parents.unionByName(named).groupBy(*key).agg(F.max("up").alias("up"))
    state = parents.join(own, key, "full_outer").select(
        *key, "up", F.coalesce("balance", F.lit(0)).cast(TOTAL).alias("balance"), F.coalesce("ledgers", F.lit(0)).alias("ledgers")
    )
    levels = None
    while True:
        folder = new_folder(spark, "rollup")
        state.write.parquet(folder)
        state = spark.read.schema(state.schema).parquet(folder)
        seen = state.agg(F.count(F.lit(1)).alias("groups"), F.count("up").alias("climbing")).first()
        levels = seen["groups"] if levels is None else levels // 2
        if not seen["climbing"]:
            break
        if not levels:
            some = ", ".join(f"{r['name']!r} of {r['company_id']!r}" for r in state.filter("up IS NOT NULL").limit(5).collect())
            raise GroupCycle(f"groups above each other in a circle: {some}")
        gained = state.filter("up IS NOT NULL").groupBy("company_id", F.col("up").alias("name")).agg(
            F.sum("balance").alias("more"), F.sum("ledgers").alias("more_ledgers")
        )
        further = state.select("company_id", F.col("name").alias("up"), F.col("up").alias("next"))
        state = (
            state.join(gained, key, "left")
            .join(further, ["company_id", "up"], "left")
            .select(
                *key,
                F.col("next").alias("up"),
                (F.col("balance") + F.coalesce("more", F.lit(0))).cast(TOTAL).alias("balance"),
                (F.col("ledgers") + F.coalesce("more_ledgers", F.lit(0))).alias("ledgers"),
            )
        )
    return state.filter("ledgers > 0").select(*key, "balance")
