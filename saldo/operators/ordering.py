"""Sorts and top-k. Null placement is always named, and the guid or name breaks ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def newest_first(vouchers: DataFrame) -> DataFrame:
    return vouchers.orderBy(F.col("date").desc_nulls_first(), F.col("tally_guid"))


def oldest_first(vouchers: DataFrame) -> DataFrame:
    return vouchers.orderBy(F.col("date").asc_nulls_last(), F.col("tally_guid"))


def most_overdue_first(outstanding: DataFrame) -> DataFrame:
    return outstanding.orderBy(
        F.col("days_overdue").desc_nulls_first(), F.col("type"), F.col("voucher_number"), F.col("party_name")
    )


def recent(vouchers: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest vouchers; each task keeps ``n`` rows, nothing is sorted as a whole."""
    return vouchers.orderBy(F.col("date").desc_nulls_last(), F.col("tally_guid")).limit(n)


def log_tail(lines: DataFrame, order: str, n: int = 501) -> DataFrame:
    """The last ``n`` log lines, trimmed, with a flag on those that report an error."""
    text = F.lower(F.col("line"))
    return (
        lines.orderBy(F.col(order).desc())
        .limit(n)
        .withColumn("is_error", text.contains("[err") | text.contains("error"))
        .withColumn("line", F.trim("line"))
    )
