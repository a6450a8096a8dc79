"""Running totals of vouchers as a stream: each voucher once, late ones within the overlap included, a day told once.

State is kept by Spark: the vouchers seen within the delay, and the open days. Both are dropped as the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from saldo.operators.aggregates import total
from saldo.operators.changes import OVERLAP_DAYS


def day_totals(vouchers: DataFrame, delay: str = f"{OVERLAP_DAYS} days") -> DataFrame:
    """Entries and total per company, type and day of a stream of vouchers, for append mode.

    A day is given out when a voucher more than ``delay`` later has been seen. Until then late vouchers count, and one that
    is read again (same company and guid) doesn't count twice. Vouchers of days given out are dropped and counted as late,
    see ``late_vouchers``. Vouchers without a date belong to no day and are left out.
    """
    dated = vouchers.filter("date IS NOT NULL").withColumn("day", F.col("date").cast("timestamp"))
    once = dated.withWatermark("day", delay).dropDuplicatesWithinWatermark(["company_id", "tally_guid"])
    return once.groupBy("company_id", "voucher_type", "day").agg(
        F.count(F.lit(1)).alias("entries"), total("amount").alias("total")
    )


def late_vouchers(query: StreamingQuery) -> int:
    """How many vouchers a run of the stream dropped as too late, as far as its recent progress tells."""
    dropped = 0
    for progress in query.recentProgress:
        for operator in progress["stateOperators"]:
            if operator["operatorName"] == "dedupeWithinWatermark":
                dropped += operator["numRowsDroppedByWatermark"]
    return dropped
