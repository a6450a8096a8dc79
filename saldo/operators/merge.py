"""Merging a batch into existing rows: upserts, replacement of children and sections, fallbacks.

All take DataFrames and give the merged DataFrame. An existing table is usually far larger than the batch, so it is only
ever the streamed side of a join on the key.

The second half merges rows that are kept with the fetch they are of, which is how ``saldo.plans.store`` has them on disk:
rows of a later fetch win, in whatever order they were written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saldo.operators.windows import latest_per_key


def upsert(
    existing: DataFrame,
    batch: DataFrame,
    keys: list[str],
    order: list[Column] | None = None,
    full_snapshot: DataFrame | None = None,
) -> DataFrame:
    """Insert or update by key; columns the batch lacks keep their old values, absent rows stay.

    ``order`` names the last write among equal keys of the batch. ``full_snapshot`` holds the scopes (such as
    companies) for which the batch is complete, so that their rows missing from it are dropped.
    """
    if order:
        batch = latest_per_key(batch, keys, order)
    supplied = [c for c in existing.columns if c in batch.columns and c not in keys]
    kept = [c for c in existing.columns if c not in supplied and c not in keys]
    if full_snapshot is not None:
        scope = full_snapshot.columns
        vanished = existing.join(full_snapshot, scope, "left_semi").join(batch, keys, "left_anti")
        existing = existing.join(vanished.select(*keys), keys, "left_anti")
    if not kept:
        rest = existing.join(batch.select(*keys), keys, "left_anti")
        return rest.unionByName(batch.select(*existing.columns))
    new = batch.select(*keys, F.struct(*supplied).alias("__new"))
    merged = existing.join(new, keys, "full_outer")
    return merged.select(
        *(
            F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c)
            if c in supplied
            else F.col(c)
            for c in existing.columns
        )
    )


def keep_when_empty(existing: DataFrame, batch: DataFrame, keys: list[str], guarded: list[str]) -> DataFrame:
    """Upsert in which an empty new value of a ``guarded`` column leaves the old one in place."""
    others = [c for c in batch.columns if c not in keys and c not in guarded]
    new = batch.select(*keys, F.struct(*others, *guarded).alias("__new"))
    merged = existing.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c in guarded:
            blank = F.trim(F.col("__new")[c].cast("string")) == ""
            return F.coalesce(F.when(~blank, F.col("__new")[c]), F.col(c)).alias(c)
        if c in others:
            return F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return merged.select(*(value(c) for c in existing.columns))


def replace_children(existing: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Children of every touched parent are exactly the new ones, which may be none."""
    return existing.join(touched.select(*keys), keys, "left_anti").unionByName(new.select(*existing.columns))


def replace_section(
    existing: DataFrame, new: DataFrame, provided: DataFrame, scope: list[str] = ("company_id",)
) -> DataFrame:
    """Rows of the scopes in ``provided`` are exactly the new ones; other scopes are left untouched.

    ``provided`` is what tells an empty section (listed, no rows) from one that was not fetched (not listed).
    """
    scope = list(scope)
    fresh = new.join(provided.select(*scope), scope, "left_semi")
    return existing.join(provided.select(*scope), scope, "left_anti").unionByName(
        fresh.select(*existing.columns)
    )


def cascade_delete(tables: dict[str, DataFrame], removed: DataFrame, key: str = "company_id") -> dict[str, DataFrame]:
    """Every table without the rows of the removed companies."""
    return {
        name: rows.join(removed.select(key), key, "left_anti") if key in rows.columns else rows
        for name, rows in tables.items()
    }


def union_outstanding(receivables: DataFrame, payables: DataFrame) -> DataFrame:
    return receivables.unionByName(payables)


def section_fallback(candidates: list[DataFrame], scope: list[str] = ("company_id",)) -> DataFrame:
    """Per scope the rows of the first candidate that has any."""
    scope = list(scope)
    ranked = None
    for rank, rows in enumerate(candidates):
        part = rows.withColumn("__rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(*scope).agg(F.min("__rank").alias("__rank"))
    return ranked.join(best, [*scope, "__rank"], "left_semi").drop("__rank")


def carries_value() -> Column:
    """Whether a stock row says anything about a value."""
    return (F.coalesce("closing_value", F.lit(0)) != 0) | (F.coalesce("rate", F.lit(0)) != 0)


def dense_or_summary(stock: DataFrame, summary: DataFrame, scope: list[str] = ("company_id",)) -> DataFrame:
    """Stock rows of a company; its summary report instead, where it has one and no stock row carries a value or a rate."""
    scope = list(scope)
    dense = stock.filter(carries_value()).select(*scope).distinct()
    instead = summary.select(*scope).distinct().join(dense, scope, "left_anti")
    return stock.join(instead, scope, "left_anti").unionByName(
        summary.join(instead, scope, "left_semi").select(*stock.columns)
    )


def split_vouchers(vouchers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vouchers with nested children -> (headers, items, ledger entries); unnamed children are dropped.

    The children are exploded as outer rows, which their names then drop: an inner generator would have its arrays' sizes
    checked below it, and so the arrays parsed twice.
    """
    valid = vouchers.filter(F.coalesce(F.trim("tally_guid"), F.lit("")) != "")
    key = ["company_id", "tally_guid"]
    headers = valid.drop("items", "ledger_entries")
    items = (
        valid.select(*key, F.explode_outer("items").alias("row"))
        .select(*key, "row.*")
        .filter(F.coalesce(F.trim("stock_item_name"), F.lit("")) != "")
    )
    entries = (
        valid.select(*key, F.explode_outer("ledger_entries").alias("row"))
        .select(*key, "row.*")
        .filter(F.coalesce(F.trim("ledger_name"), F.lit("")) != "")
    )
    if "bill_allocations" in entries.columns:
        none = F.array().cast(entries.schema["bill_allocations"].dataType)
        entries = entries.withColumn("bill_allocations", F.coalesce("bill_allocations", none))
    return headers, items, entries


# ---- rows with their fetch -------------------------------------------------------------------------------

#: What orders the writes of a key: the fetch, the document and place within it (two numbers in large files), and the batch.
VERSION = ("fetched_at", "path", "pos", "line", "batch_id")


def last_write() -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in VERSION]


def newest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the row of the latest fetch."""
    return latest_per_key(rows, keys, last_write())


def newest_values(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of every key and column the value of the latest fetch that filled it."""

    def last(name: str) -> Column:
        filled = F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) != ""
        return F.max_by(F.col(name), F.when(filled, F.struct("fetched_at", "batch_id"))).alias(name)

    return rows.groupBy(*keys).agg(*(last(c) for c in columns))


def without_sections(rows: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Rows but those that a fetch read from one of the ``unwanted`` sections (company_id, origin, fetched_at)."""
    return rows.join(unwanted.select("company_id", "origin", "fetched_at"), ["company_id", "origin", "fetched_at"], "left_anti")


def newest_sections(rows: DataFrame, provided: DataFrame) -> DataFrame:
    """Of every company and section the rows of its newest fetch in ``provided``, which may have had none."""
    last = provided.groupBy("company_id", "origin").agg(F.max("fetched_at").alias("fetched_at"))
    return rows.join(last, ["company_id", "origin", "fetched_at"], "left_semi")


def without_vanished(rows: DataFrame, snapshots: DataFrame, day: str | None = None) -> DataFrame:
    """Rows but those older than a snapshot (company_id, fetched_at, from_date, to_date) that does not list them any more.

    A row that is listed has a newer write of that fetch, so every older one may go. With ``day`` a snapshot only speaks
    for its dates; an open end has no limit.
    """
    if day is None:
        last = snapshots.groupBy(F.col("company_id").alias("s_company")).agg(F.max("fetched_at").alias("s_fetch"))
        older = (F.col("company_id") == F.col("s_company")) & (F.col("fetched_at") < F.col("s_fetch"))
    else:
        last = snapshots.select(
            F.col("company_id").alias("s_company"), F.col("fetched_at").alias("s_fetch"), "from_date", "to_date"
        ).distinct()
        older = (F.col("company_id") == F.col("s_company")) & (F.col("fetched_at") < F.col("s_fetch"))
        older = older & F.coalesce(F.col(day) >= F.col("from_date"), F.lit(True))
        older = older & F.coalesce(F.col(day) <= F.col("to_date"), F.lit(True))
    return rows.join(last, older, "left_anti")


def without_removed(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows but those of removed companies (company_id, fetched_at) of that fetch or older; a later fetch starts anew."""
    last = removed.groupBy(F.col("company_id").alias("r_company")).agg(F.max("fetched_at").alias("r_fetch"))
    gone = (F.col("company_id") == F.col("r_company")) & (F.coalesce("fetched_at", F.lit("")) <= F.col("r_fetch"))
    return rows.join(last, gone, "left_anti")
