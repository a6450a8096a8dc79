"""Outstanding bills straight from the text of a report, for reports whose lists do not line up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saldo.functions import scalars as S
from saldo.schema import MONEY

# The tags beside a bill, in order.
BESIDE = ("BILLCL", "BILLDUE", "BILLOVERDUE")


def bills_by_pattern(responses: DataFrame, kind: str) -> DataFrame:
    """Only complete bills count; one without its amount or dates beside it is skipped.

    A document is cut after each bill's head; what follows up to the next head must begin with the three tags.
    """
    carried = [c for c in responses.columns if c != "text"]
    after = F.transform(F.split("text", "</BILLFIXED>"), lambda part, i: F.struct(i.alias("i"), part.alias("part")))
    pieces = responses.select(*carried, after.alias("parts"))
    heads = F.transform(
        F.filter("parts", lambda p: p.i > 0),
        lambda p: F.struct(
            # The head itself ends the part before.
            F.substring_index(F.get("parts", p.i - 1).part, "<BILLFIXED>", -1).alias("head"),
            F.get("parts", p.i - 1).part.contains("<BILLFIXED>").alias("opened"),
            F.trim(p.part, F.lit(S.BLANKS)).alias("tail"),
        ),
    )
    blocks = pieces.select(*carried, F.posexplode(heads).alias("pos", "bill"))
    beside = r"(?s)^\s*" + r"\s*".join(f"<{name}>[^<]*</{name}>" for name in BESIDE)
    blocks = blocks.filter("bill.opened").filter(F.col("bill.tail").rlike(beside))
    blocks = blocks.withColumn("block", F.concat("bill.head", F.regexp_extract("bill.tail", beside, 0)))

    def tag(name: str):
        return F.trim(F.regexp_extract("block", f"<{name}>([^<]*)</{name}>", 1))

    amount = S.abs_float(tag("BILLCL")).try_cast(MONEY)
    return blocks.select(
        *carried,
        "pos",
        S.unescape(tag("BILLPARTY")).alias("party_name"),
        F.lit(kind).alias("type"),
        S.unescape(tag("BILLREF")).alias("voucher_number"),
        S.parse_date(tag("BILLDATE")).alias("voucher_date"),
        S.parse_date(tag("BILLDUE")).alias("due_date"),
        amount.alias("original_amount"),
        amount.alias("pending_amount"),
        S.int_of_float(tag("BILLOVERDUE")).alias("days_overdue"),
    ).filter(F.col("party_name") != "")
