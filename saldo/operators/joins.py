"""Joins of the ledger model. No broadcast hints: sides grow with the data, so sizes decide at run time."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from saldo.operators.aggregates import outstanding_by_party
from saldo.operators.skew import PAGE_ROWS, paged_lists

VOUCHER = ["company_id", "tally_guid"]


class CompanyNotFound(LookupError):
    pass


def company_id_of(companies: DataFrame, name: str) -> str:
    """Id of the one company with this name; anything but exactly one is an error."""
    found = companies.filter(F.col("name") == name).select("company_id").limit(2).collect()
    if len(found) != 1:
        raise CompanyNotFound(f"{len(found)} companies are called {name!r}")
    return found[0]["company_id"]


def company_by_name(rows: DataFrame, companies: DataFrame, column: str = "company_name") -> DataFrame:
    """Rows with the id of the company they name; a name that is missing or not unique has no id."""
    unique = (
        companies.groupBy("name")
        .agg(F.min("company_id").alias("company_id"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == 1)
        .select(F.col("name").alias(column), "company_id")
    )
    return rows.join(unique, column, "inner")


def voucher_ids(children: DataFrame, vouchers: DataFrame) -> DataFrame:
    """Children with their voucher's id. ``missing_vouchers`` lists those without one."""
    return children.join(vouchers.select(*VOUCHER, F.col("id").alias("voucher_id")), VOUCHER, "inner")


def missing_vouchers(children: DataFrame, vouchers: DataFrame) -> DataFrame:
    return children.join(vouchers.select(*VOUCHER), VOUCHER, "left_anti").select(*VOUCHER).distinct()


def item_entry(items: DataFrame) -> Column:
    return F.struct(*(c for c in items.columns if c not in (*VOUCHER, "voucher_id", "id", "line")))


def vouchers_with_items(
    vouchers: DataFrame, items: DataFrame, page_rows: int | None = PAGE_ROWS, only: str | None = None
) -> DataFrame:
    """Vouchers with their items as a nested array, empty when there are none.

    A row is one page of a voucher's items, by their ``line``: the key is the voucher and ``item_page``. Vouchers of at most
    ``page_rows`` items have the page 0 only; without ``page_rows`` every voucher has. With ``only``, an item is given by that
    column alone, in the same order.
    """
    nested = paged_lists(items, VOUCHER, item_entry(items), "items", "line", page_rows)
    if only is not None:
        nested = nested.withColumn("items", F.col("items")[only])
    empty = F.array().cast(nested.schema["items"].dataType)
    return (
        vouchers.join(nested, VOUCHER, "left")
        .withColumn("items", F.coalesce("items", empty))
        .withColumn("item_page", F.coalesce("page", F.lit(0).cast("bigint")))
        .drop("page")
    )


def vouchers_with_item_counts(vouchers: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy(*VOUCHER).agg(F.count(F.lit(1)).alias("item_count"))
    return vouchers.join(counts, VOUCHER, "left").withColumn(
        "item_count", F.coalesce("item_count", F.lit(0).cast("bigint"))
    )


def parties_with_outstanding(parties: DataFrame, outstanding: DataFrame) -> DataFrame:
    totals = outstanding_by_party(outstanding).withColumnRenamed("party_name", "name")
    return parties.join(totals, ["company_id", "name"], "left").withColumn(
        "total_outstanding", F.coalesce("total_outstanding", F.lit(0).cast("decimal(28,2)"))
    )


class PartyProfile(NamedTuple):
    ledgers: DataFrame
    bills: DataFrame
    vouchers: DataFrame


def single_ledgers(ledgers: DataFrame) -> DataFrame:
    """Ledger row of each party that has exactly one; others count as having none."""
    columns = [c for c in ledgers.columns if c not in ("company_id", "name")]
    return (
        ledgers.groupBy("company_id", "name")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            *(F.any_value(F.col(c)).alias(c) for c in columns),
        )
        .filter(F.col("__n") == 1)
        .drop("__n")
    )


def party_profile(ledgers: DataFrame, outstanding: DataFrame, vouchers: DataFrame) -> PartyProfile:
    """A party's (or every party's) ledger row, open bills and vouchers, each keyed by company and party."""
    return PartyProfile(
        single_ledgers(ledgers).withColumnRenamed("name", "party_name"), outstanding, vouchers
    )


def merge_counts(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """New count per key where there is one, else the old."""
    old, new = base.withColumnRenamed("n", "old_n"), updates.withColumnRenamed("n", "new_n")
    return old.join(new, keys, "full_outer").select(*keys, F.coalesce("new_n", "old_n").alias("n"))


def keep_unreplaced(existing: DataFrame, replaced: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(replaced.select(*keys), keys, "left_anti")
