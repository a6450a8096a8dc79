"""Row predicates of the ledger model. Each is a plain filter, so Parquet scans can use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saldo.functions import scalars as S

# Fixed values.
PARTY_GROUPS = (S.DEBTOR_GROUP, S.CREDITOR_GROUP)


def required(df: DataFrame, field: str) -> DataFrame:
    return df.filter(S.safe_str(F.col(field).cast("string")) != "")


def valid_guid(vouchers: DataFrame) -> DataFrame:
    return required(vouchers, "tally_guid")


def named_items(items: DataFrame) -> DataFrame:
    return required(items, "stock_item_name")


def named_entries(entries: DataFrame) -> DataFrame:
    return required(entries, "ledger_name")


def _not(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def not_cancelled(vouchers: DataFrame) -> DataFrame:
    return vouchers.filter(_not("is_cancelled"))


def not_optional(vouchers: DataFrame) -> DataFrame:
    return vouchers.filter(_not("is_optional"))


def non_aggregate(companies: DataFrame) -> DataFrame:
    return companies.filter(~S.bool_yesno(F.col("is_aggregate")))


def date_window(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """Both ends included; ``yyyymmdd`` texts become date literals so that the scan sees a range."""

    def day(compact: str) -> Column:
        return F.lit(f"{compact[:4]}-{compact[4:6]}-{compact[6:]}").cast("date")

    return df.filter(F.col(column).between(day(start), day(end)))


def of_company(df: DataFrame, company_id) -> DataFrame:
    """Scope to one company; prunes partitions where ``company_id`` is the partition column."""
    return df.filter(F.col("company_id") == F.lit(company_id))


def of_party(df: DataFrame, party: str, column: str = "party_name") -> DataFrame:
    return df.filter(F.col(column) == F.lit(party))


def parties(ledgers: DataFrame) -> DataFrame:
    return ledgers.filter(F.col("group_name").isin(*PARTY_GROUPS))


def of_voucher_type(vouchers: DataFrame, kind: str = "All") -> DataFrame:
    return vouchers if kind == "All" else vouchers.filter(F.col("voucher_type") == kind)


def of_outstanding_type(outstanding: DataFrame, kind: str) -> DataFrame:
    return outstanding.filter(F.col("type") == kind)


def of_party_type(party_rows: DataFrame, kind: str) -> DataFrame:
    return party_rows.filter(F.col("type") == kind)


def enabled_companies(df: DataFrame, config: DataFrame) -> DataFrame:
    """Rows of companies switched on in ``config(company_id, enabled)``."""
    return df.join(config.filter("enabled").select("company_id"), "company_id", "left_semi")
