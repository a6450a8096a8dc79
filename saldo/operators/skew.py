"""Groups that hold too many rows for one task, split by their own order: one plan for all data, without counting first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAGE_ROWS = 10_000


def paged_lists(
    rows: DataFrame, keys: list[str], entry: Column, name: str, line: str = "line", page_rows: int | None = PAGE_ROWS
) -> DataFrame:
    """Rows of a key gathered into sorted arrays by their position: (keys, page, name).

    ``line`` is the row's place in its key, from 0 on; page n holds the places from n * ``page_rows`` on, so that a page
    holds at most ``page_rows`` entries and a large key spreads over many tasks. Without ``page_rows`` all is one page.
    """
    page = F.lit(0) if page_rows is None else F.floor(F.col(line) / F.lit(page_rows))
    entries = rows.select(*keys, page.cast("bigint").alias("page"), entry.alias("entry"))
    return entries.groupBy(*keys, "page").agg(F.sort_array(F.collect_list("entry")).alias(name))
