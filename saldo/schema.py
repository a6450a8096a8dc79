"""The ledger model: column types, keys and write rules of every stored table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

MONEY = "decimal(18,2)"
QUANTITY = "decimal(18,4)"

ITEM = f"""stock_item_name string, quantity {QUANTITY}, unit string, rate {QUANTITY},
           discount_pct {QUANTITY}, amount {MONEY}, signed_quantity {QUANTITY}"""
BILL_ALLOCATION = f"name string, bill_type string, amount {MONEY}"
LEDGER_ENTRY = f"""ledger_name string, amount {MONEY}, is_party_ledger boolean, is_deemed_positive boolean,
                   bill_allocations array<struct<{BILL_ALLOCATION.replace(' string', ':string').replace(' decimal', ':decimal')}>>"""


@dataclass(frozen=True)
class Table:
    name: str
    columns: str
    key: tuple[str, ...] = ()
    rule: str = "upsert"  # upsert | children | replace | append

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)

    def conform(self, df: DataFrame) -> DataFrame:
        """The table's own columns out of ``df``, cast to the declared types; absent ones are null."""
        return df.select(
            *(
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.schema.fields
            )
        )


TABLES = {
    t.name: t
    for t in (
        Table(
            "companies",
            """company_id string, name string, last_synced_at timestamp, books_from date, books_to date,
               gstin string, address string""",
            ("name",),
        ),
        Table(
            "groups",
            """company_id string, name string, parent string, master_id long, is_revenue string,
               affects_stock string, is_subledger string, synced_at timestamp""",
            ("company_id", "name"),
        ),
        Table(
            "ledgers",
            f"""company_id string, name string, group_name string, opening_balance {MONEY},
                closing_balance {MONEY}, master_id long, email string, phone string, mobile string,
                pincode string, gstin string, state string, country string, credit_period string,
                credit_limit {MONEY}, bank_account string, ifsc_code string, pan string,
                mailing_name string, guid string, synced_at timestamp""",
            ("company_id", "name"),
        ),
        Table(
            "vouchers",
            f"""company_id string, tally_guid string, voucher_number string, voucher_type string, date date,
                party_name string, amount {MONEY}, narration string, is_cancelled boolean,
                reference string, is_invoice boolean, view string, synced_at timestamp""",
            ("company_id", "tally_guid"),
        ),
        Table(
            "voucher_items",
            f"company_id string, voucher_id string, tally_guid string, {ITEM}",
            ("company_id", "tally_guid"),
            "children",
        ),
        Table(
            "voucher_ledger_entries",
            f"company_id string, voucher_id string, tally_guid string, {LEDGER_ENTRY}",
            ("company_id", "tally_guid"),
            "children",
        ),
        Table(
            "stock_items",
            f"""company_id string, name string, group_name string, unit string, closing_qty {QUANTITY},
                signed_qty {QUANTITY}, closing_value {MONEY}, rate {QUANTITY}, synced_at timestamp""",
            ("company_id", "name"),
        ),
        Table(
            "outstanding",
            f"""company_id string, party_name string, type string, voucher_number string,
                voucher_date date, due_date date, original_amount {MONEY}, pending_amount {MONEY},
                days_overdue int, synced_at timestamp""",
            ("company_id",),
            "replace",
        ),
        Table(
            "profit_loss",
            f"""company_id string, particulars string, amount {MONEY}, is_debit boolean,
                raw_amount {MONEY}, is_income boolean, level string, synced_at timestamp""",
            ("company_id",),
            "replace",
        ),
        Table(
            "balance_sheet",
            f"company_id string, particulars string, amount {MONEY}, side string, synced_at timestamp",
            ("company_id",),
            "replace",
        ),
        Table(
            "trial_balance",
            f"""company_id string, particulars string, debit {MONEY}, credit {MONEY}, synced_at timestamp""",
            ("company_id",),
            "replace",
        ),
        Table(
            "sync_log",
            """company_id string, synced_at timestamp, status string,
               records_synced map<string,bigint>, error_message string""",
            (),
            "append",
        ),
        Table(
            "change_markers",
            """company_id string, alter_id string, alt_vch_id string, vch_id string, alt_mst_id string,
               last_voucher_date date""",
            ("company_id",),
        ),
    )
}


def surrogate_id(*parts):
    """Row id that every rerun gives again: a digest of the natural key."""
    return F.sha2(F.concat_ws("|", *parts), 256)
