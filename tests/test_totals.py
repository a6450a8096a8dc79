"""Running totals of a stream of vouchers: late ones within a week count, later ones are counted as late."""

from datetime import date
from decimal import Decimal as D

from saldo.streaming.totals import day_totals, late_vouchers

VOUCHER = "company_id string, tally_guid string, voucher_type string, date date, amount decimal(18,2)"


def test_day_totals(spark, tmp_path):
    landing, out = str(tmp_path / "vouchers"), str(tmp_path / "totals")

    def land(*rows):
        df = spark.createDataFrame([("1", g, "Sales", d and date.fromisoformat(d), D(a)) for g, d, a in rows], VOUCHER)
        df.coalesce(1).write.mode("append").parquet(landing)

    def run():
        stream = spark.readStream.schema(VOUCHER).parquet(landing)
        query = (
            day_totals(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return late_vouchers(query)

    land(("a", "2025-04-01", 10), ("b", "2025-04-20", 5), ("c", "2025-04-14", -7), ("d", None, 1))
    assert run() == 0
    # The first of April is given out. c is read again, d2 is late by less than a week, e and f by more.
    land(("c", "2025-04-14", -7), ("d2", "2025-04-14", 3), ("e", "2025-04-01", 100), ("f", "2025-04-13", 100), ("z", "2025-06-01", 0))
    assert run() == 2
    found = {str(r["day"])[:10]: (r["entries"], int(r["total"])) for r in spark.read.parquet(out).collect()}
    assert found == {"2025-04-01": (1, 10), "2025-04-14": (2, 10), "2025-04-20": (1, 5)}
