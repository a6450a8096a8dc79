"""Ordered computations: running balance and latest row per key."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from saldo.functions import scalars as S
from saldo.session import new_folder

PARTY = ["company_id", "party_name"]
#: About how many vouchers of one party are summed in one group.
CHUNK = 500_000
#: Sampled vouchers per chunk, from which its bounds are taken.
SAMPLES = 16
#: Bounds of a party that are compared one by one; beyond that, groups of as many are.
STEP = 64
#: Bounds that are sent to all tasks.
BROADCAST = 100_000


def running_balance(
    vouchers: DataFrame, debit_types: tuple[str, ...] = S.DEBIT_VOUCHER_TYPES, chunk: int = CHUNK
) -> DataFrame:
    """Balance of each party after each voucher, by date and then guid, starting from 0.

    A prefix sum in parallel: a party with more than ``chunk`` vouchers or so is cut by rank into ranges of (date, guid),
    whatever its dates and guids look like; each range is summed as a group of its own, and the totals of the ranges before
    are added. The bounds are every SAMPLES-th of the vouchers that a hash of the guid picks, so they fall where the
    vouchers are; the result doesn't depend on them. They are found by a first job over the keys. Only cut parties have
    bounds and totals, one per chunk; up to BROADCAST of them they go to all tasks, beyond that they are joined by party.
    """
    spark = vouchers.sparkSession
    signed = S.signed_amount("voucher_type", "amount", debit_types).cast("decimal(28,2)")
    rows = vouchers.withColumn("signed_amount", signed)
    place = F.struct(
        F.col("date").isNull().alias("undated"), "date", F.col("tally_guid").isNull().alias("unnamed"), "tally_guid"
    )
    every = max(1, chunk // SAMPLES)
    picked = vouchers.filter(F.pmod(F.xxhash64("tally_guid", "date"), F.lit(every)) == 0)
    sampled = picked.groupBy(*(F.col(k).alias("b_" + k) for k in PARTY)).agg(F.sort_array(F.collect_list(place)).alias("places"))
    # Every SAMPLES-th place, in groups of STEP so that a voucher is compared with few of them.
    bounds = F.expr(f"transform(sequence({SAMPLES} - 1, size(places) - 1, {SAMPLES}), i -> places[i])")
    grouped = F.expr(f"transform(sequence(0, (size(bounds) - 1) div {STEP}), g -> slice(bounds, g * {STEP} + 1, {STEP}))")
    cut = sampled.filter(F.size("places") >= SAMPLES).withColumn("bounds", bounds)
    cut = cut.select(*("b_" + k for k in PARTY), grouped.alias("bounds"))
    folder = new_folder(spark, "bounds")
    cut.write.parquet(folder)
    cut = spark.read.schema(cut.schema).parquet(folder)
    found = cut.agg(F.coalesce(F.sum(F.size(F.flatten("bounds"))), F.lit(0))).first()[0]

    def within(group: list[str]) -> Column:
        window = Window.partitionBy(*group).orderBy(F.col("date").asc_nulls_last(), F.col("tally_guid").asc_nulls_last())
        return F.sum("signed_amount").over(window.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(28,2)")

    if not found:
        return rows.withColumn("running_balance", within(PARTY))
    small = F.broadcast if found <= BROADCAST else (lambda df: df)
    rows = rows.join(small(cut), _same(PARTY, "b_"), "left").withColumn("__place", place)
    # The chunk is the number of bounds up to the voucher: whole groups of them, then those of the group it falls in.
    whole = F.expr("size(filter(bounds, g -> g[size(g) - 1] <= __place))")
    rows = rows.withColumn("__whole", F.when(F.col("bounds").isNotNull(), whole))
    rest = F.expr(f"__whole * {STEP} + coalesce(size(filter(get(bounds, __whole), b -> b <= __place)), 0)")
    rows = rows.withColumn("__chunk", F.coalesce(rest, F.lit(0))).drop("__place", "__whole")

    parts = rows.filter(F.col("bounds").isNotNull()).groupBy(*PARTY, "__chunk").agg(F.sum("signed_amount").alias("__total"))
    earlier = Window.partitionBy(*PARTY).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    opening = parts.select(
        *(F.col(k).alias("o_" + k) for k in PARTY), F.col("__chunk").alias("o___chunk"), F.sum("__total").over(earlier).alias("__opening")
    ).filter(F.col("__opening").isNotNull())
    group = [*PARTY, "__chunk"]
    return (
        rows.withColumn("__within", within(group))
        .join(small(opening), _same(group, "o_"), "left")
        .withColumn("running_balance", (F.col("__within") + F.coalesce("__opening", F.lit(0))).cast("decimal(28,2)"))
        .select(*vouchers.columns, "signed_amount", "running_balance")
    )


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(and_, (F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write per key. Spark keeps only the first of each key per task before the shuffle."""
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", ranked).filter(F.col("__rank") == 1).drop("__rank")
