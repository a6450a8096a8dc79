"""Collection queries and period statistics over any DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def collection_query(
    rows: DataFrame,
    fetch: Sequence[str] = (),
    filters: Sequence[str | Column] = (),
    walk: Sequence[str] = (),
    compute: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Walk into nested lists, compute named expressions, filter by formula and fetch fields.

    Filters on the outer fields come before the walk where Catalyst can move them there.
    """
    for path in walk:
        name = path.split(".")[-1]
        rows = rows.withColumn(name, F.explode(path))
    for name, expression in (compute or {}).items():
        rows = rows.withColumn(name, F.expr(expression) if isinstance(expression, str) else expression)
    for condition in filters:
        rows = rows.filter(condition)
    names = [*fetch, *(n for n in (compute or {}) if n not in fetch)]
    return rows.select(*names) if names else rows


def period_statistics(
    rows: DataFrame, periods: Sequence[tuple[str, str]], kind: str = "voucher_type", date: str = "date"
) -> DataFrame:
    """Rows by type in each (from, to) period, ends included; periods may overlap.

    Rows are first counted by day and type, so only those few counts are matched with the periods.
    """
    listed = F.array(
        *(
            F.struct(F.lit(start).cast("date").alias("from_date"), F.lit(end).cast("date").alias("to_date"))
            for start, end in periods
        )
    )
    by_day = rows.groupBy(F.col(date).alias("day"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    hits = F.filter(listed, lambda p: F.col("day").between(p["from_date"], p["to_date"]))
    return (
        by_day.select("kind", "n", F.explode(hits).alias("period"))
        .groupBy("period.from_date", "period.to_date", F.col("kind").alias(kind))
        .agg(F.sum("n").alias("records"))
    )
