"""The ledger sections: row places, tags and finishing rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saldo.functions import scalars as S
from saldo.schema import MONEY, QUANTITY
from saldo.sources.definitions import COLLECTION, Child, Section, fields


# ---- finishing rules --------------------------------------------------------------------------------


def voucher_amount(amount, items, entries):
    """Header amount; when 0, the items' total, else the largest party entry, else the largest entry."""
    zero = F.lit(0).cast(MONEY)
    sizes = F.transform(entries, lambda e: F.abs(e["amount"]))
    party = F.transform(F.filter(entries, lambda e: e["is_party_ledger"]), lambda e: F.abs(e["amount"]))
    item_total = F.aggregate(
        items, F.lit(0).cast("decimal(28,2)"), lambda t, i: (t + F.abs(i["amount"])).cast("decimal(28,2)")
    ).cast(MONEY)
    return (
        F.when(amount != 0, F.abs(amount))
        .when(F.size(items) > 0, item_total)
        .when(F.size(party) > 0, F.array_max(party))
        .otherwise(F.coalesce(F.array_max(sizes), zero))
    )


def _finish_vouchers(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "amount", voucher_amount(F.col("amount"), F.col("items"), F.col("ledger_entries"))
    )


def _finish_profit_loss(rows: DataFrame) -> DataFrame:
    """Sign flags are kept both as stored before (``is_debit``) and as income; ``level`` tells totals apart."""
    raw = F.when(F.col("sub_text") != "", F.col("sub_amount")).otherwise(F.col("main_amount"))
    level = F.when(F.col("sub_text") != "", "sub").when(F.col("main_text") != "", "main").otherwise("none")
    return (
        rows.withColumn("raw_amount", raw)
        .withColumn("amount", F.abs("raw_amount"))
        .withColumn("is_debit", F.col("raw_amount") >= 0)
        .withColumn("is_income", F.col("raw_amount") > 0)
        .withColumn("level", level)
        .drop("sub_text", "main_text", "sub_amount", "main_amount")
    )


def _finish_balance_sheet(rows: DataFrame) -> DataFrame:
    signed = F.when(F.col("main_text") != "", F.col("main_amount")).otherwise(F.col("sub_amount"))
    has_signed = (F.col("main_text") != "") | (F.col("sub_text") != "")
    side = (
        F.when(has_signed & (signed > 0), "liability")
        .when(has_signed, "asset")
        .when(F.col("debit") != 0, "asset")
        .otherwise("liability")
    )
    amount = F.when(has_signed, F.abs(signed)).when(F.col("debit") != 0, F.col("debit")).otherwise(F.col("credit"))
    return (
        rows.withColumn("amount", amount)
        .withColumn("side", side)
        .drop("main_text", "sub_text", "main_amount", "sub_amount", "debit", "credit")
    )


def _finish_stock(rows: DataFrame) -> DataFrame:
    """Stored quantity and value carry no sign; the sign is kept beside them."""
    return (
        rows.withColumn("is_negative", F.col("signed_qty") < 0)
        .withColumn("closing_qty", F.abs("signed_qty"))
        .withColumn("closing_value", F.abs("closing_value"))
    )


def _finish_stock_summary(rows: DataFrame) -> DataFrame:
    """In this report the unit is the word after the number, so a lone word is no unit."""
    second = F.regexp_extract("quantity_text", r"^\s*\S+\s+(\S+)", 1)
    return _finish_stock(
        rows.withColumn("unit", F.when(second != "", second).otherwise("Nos"))
        .withColumn("group_name", F.lit(""))
        .drop("quantity_text")
    )


def _finish_alter_ids(rows: DataFrame) -> DataFrame:
    return rows.select(
        *(c for c in rows.columns if c not in ("alter_id", "alt_vch_id", "vch_id", "alt_mst_id", "last_voucher_date")),
        *(F.col(c).cast("string").alias(c) for c in ("alter_id", "alt_vch_id", "vch_id", "alt_mst_id")),
        "last_voucher_date",
    )


# ---- fixed values: sections, their tags and defaults -------------------------------------------------

COMPANY_INFO = Section(
    "company_info",
    mode="single",
    rows=(f"{COLLECTION}/COMPANY",),
    fields=fields(
        """
        name            string  NAME @NAME
        books_from      date    BOOKSFROM
        books_to        date    BOOKSTO
        books_from_raw  string  BOOKSFROM
        books_to_raw    string  BOOKSTO
        guid            string  GUID
        master_id       int     MASTERID
        address         string  BASICCOMPANYADDRESS
        state           string  STATENAME
        country         string  COUNTRYNAME
        pincode         string  PINCODE
        email           string  EMAIL
        phone           string  PHONENUMBER
        gst_type        string  GSTREGISTRATIONTYPE
        gstin           string  PARTYGSTIN
        pan             string  INCOMETAXNUMBER
        """
    ),
)

ALTER_IDS = Section(
    "alter_ids",
    mode="single",
    rows=(f"{COLLECTION}/COMPANY",),
    fields=fields(
        """
        alter_id           int   ALTERID
        alt_vch_id         int   ALTVCHID
        vch_id             int   CMPVCHID
        alt_mst_id         int   ALTMSTID
        last_voucher_date  date  LASTVOUCHERDATE
        """
    ),
    finish=_finish_alter_ids,
)

#: What a fetch holds: per section the number of its documents, and whether they list all rows that there are.
MANIFEST = Section(
    "manifest",
    rows=(f"{COLLECTION}/SECTION",),
    required="listed",
    fields=fields(
        """
        listed     string      @NAME NAME
        documents  int         @DOCUMENTS DOCUMENTS
        snapshot   bool_yesno  @SNAPSHOT SNAPSHOT
        """
    ),
)

GROUPS = Section(
    "groups",
    rows=(f"{COLLECTION}/GROUP",),
    required="name",
    fields=fields(
        """
        name           string     NAME @NAME
        parent         string     PARENT
        master_id      int        MASTERID
        is_revenue     string=No  ISREVENUE
        affects_stock  string=No  AFFECTSSTOCK
        is_subledger   string=No  ISSUBLEDGER
        """
    ),
)

LEDGERS = Section(
    "ledgers",
    rows=(f"{COLLECTION}/LEDGER", "messages/LEDGER"),
    required="name",
    fields=fields(
        """
        name             string  NAME @NAME
        group_name       string  PARENT
        opening_balance  float   OPENINGBALANCE
        closing_balance  float   CLOSINGBALANCE
        master_id        int     MASTERID
        email            string  EMAIL
        phone            string  LEDGERPHONE
        mobile           string  LEDGERMOBILE
        pincode          string  PINCODE
        gstin            string  PARTYGSTIN
        state            string  LEDSTATENAME
        country          string  COUNTRYNAME
        credit_period    string  CREDITPERIOD
        credit_limit     float   CREDITLIMIT
        bank_account     string  BANKACCOUNT
        ifsc_code        string  IFSCODE
        pan              string  INCOMETAXNUMBER
        mailing_name     string  MAILINGNAME
        guid             string  GUID
        """,
        {"opening_balance": MONEY, "closing_balance": MONEY, "credit_limit": MONEY},
    ),
    # The stand-in currency row of message exports is named so.
    keep=lambda: F.col("name") != "?",
)

BILL_ALLOCATIONS = Child(
    "bill_allocations",
    ("BILLALLOCATIONS.LIST",),
    fields(
        """
        name       string  NAME
        bill_type  string  BILLTYPE
        amount     float   AMOUNT
        """,
        {"amount": MONEY},
    ),
)

VOUCHER_ITEMS = Child(
    "items",
    ("ALLINVENTORYENTRIES.LIST", "INVENTORYENTRIES.LIST"),
    fields(
        """
        stock_item_name  string              STOCKITEMNAME
        quantity         quantity_value_abs  ACTUALQTY
        unit             quantity_unit=Nos   ACTUALQTY
        rate             float               RATE
        discount_pct     float               DISCOUNT
        amount           float               AMOUNT
        signed_quantity  float               ACTUALQTY
        """,
        {"quantity": QUANTITY, "rate": QUANTITY, "discount_pct": QUANTITY, "amount": MONEY, "signed_quantity": QUANTITY},
    ),
    required="stock_item_name",
)

LEDGER_ENTRIES = Child(
    "ledger_entries",
    ("ALLLEDGERENTRIES.LIST", "LEDGERENTRIES.LIST"),
    fields(
        """
        ledger_name         string      LEDGERNAME
        amount              float       AMOUNT
        is_party_ledger     bool_yesno  ISPARTYLEDGER
        is_deemed_positive  bool_yesno  ISDEEMEDPOSITIVE
        """,
        {"amount": MONEY},
    ),
    (BILL_ALLOCATIONS,),
    required="ledger_name",
)

VOUCHERS = Section(
    "vouchers",
    rows=(f"{COLLECTION}/VOUCHER", "messages/VOUCHER"),
    required="tally_guid",
    fields=fields(
        """
        tally_guid      string      @REMOTEID GUID
        voucher_number  string      VOUCHERNUMBER
        voucher_type    string      @VCHTYPE VOUCHERTYPENAME
        date            date        DATE
        party_name      string      PARTYLEDGERNAME
        amount          float       AMOUNT
        narration       string      NARRATION
        is_cancelled    bool_yesno  ISCANCELLED
        reference       string      REFERENCE
        is_invoice      bool_yesno  ISINVOICE
        view            string      PERSISTEDVIEW @OBJVIEW
        """,
        {"amount": MONEY},
    ),
    children=(VOUCHER_ITEMS, LEDGER_ENTRIES),
    finish=_finish_vouchers,
)


def _outstanding(kind: str) -> Section:
    return Section(
        f"outstanding_{kind}s",
        mode="indexed_rows",
        length="bill",
        index={"bill": "BILLFIXED", "closing": "BILLCL", "due": "BILLDUE", "overdue": "BILLOVERDUE"},
        required="party_name",
        fields=fields(
            f"""
            party_name       string  bill/BILLPARTY
            type             string={kind}
            voucher_number   string  bill/BILLREF
            voucher_date     date    bill/BILLDATE
            due_date         date    due
            original_amount  abs_float  closing
            pending_amount   abs_float  closing
            days_overdue     float   overdue
            """,
            {"original_amount": MONEY, "pending_amount": MONEY, "days_overdue": "int"},
        ),
    )


OUTSTANDING_RECEIVABLES = _outstanding("receivable")
OUTSTANDING_PAYABLES = _outstanding("payable")

PROFIT_LOSS = Section(
    "profit_loss",
    mode="indexed_rows",
    length="name_row",
    index={"name_row": "DSPACCNAME", "amount_row": "PLAMT"},
    required="particulars",
    fields=fields(
        """
        particulars  string  name_row/DSPDISPNAME
        sub_text     string  amount_row/PLSUBAMT
        main_text    string  amount_row/BSMAINAMT
        sub_amount   float   amount_row/PLSUBAMT
        main_amount  float   amount_row/BSMAINAMT
        """,
        {"sub_amount": MONEY, "main_amount": MONEY},
    ),
    finish=_finish_profit_loss,
)

BALANCE_SHEET = Section(
    "balance_sheet",
    mode="indexed_rows",
    length="name_row",
    index={"name_row": "DSPACCNAME", "amount_row": "BSAMT", "info_row": "DSPACCINFO"},
    required="particulars",
    fields=fields(
        """
        particulars  string     name_row/DSPDISPNAME
        main_text    string     amount_row/BSMAINAMT
        sub_text     string     amount_row/BSSUBAMT
        main_amount  float      amount_row/BSMAINAMT
        sub_amount   float      amount_row/BSSUBAMT
        debit        abs_float  info_row/DSPCLDRAMT/DSPCLDRAMTA
        credit       abs_float  info_row/DSPCLCRAMT/DSPCLCRAMTA
        """,
        {"main_amount": MONEY, "sub_amount": MONEY, "debit": MONEY, "credit": MONEY},
    ),
    finish=_finish_balance_sheet,
)

TRIAL_BALANCE = Section(
    "trial_balance",
    mode="indexed_rows",
    length="name_row",
    index={"name_row": "DSPACCNAME", "info_row": "DSPACCINFO"},
    required="particulars",
    fields=fields(
        """
        particulars  string     name_row/DSPDISPNAME
        debit        abs_float  info_row/DSPCLDRAMT/DSPCLDRAMTA
        credit       abs_float  info_row/DSPCLCRAMT/DSPCLCRAMTA
        """,
        {"debit": MONEY, "credit": MONEY},
    ),
)

STOCK_ITEMS = Section(
    "stock_items",
    rows=(f"{COLLECTION}/STOCKITEM",),
    required="name",
    fields=fields(
        """
        name           string             NAME @NAME
        group_name     string             PARENT
        unit           quantity_unit=Nos  BASEUNITS CLOSINGBALANCE STKCLOSINGBALANCE STKCLBALANCE CLOSINGQTY
        signed_qty     float              CLOSINGBALANCE STKCLOSINGBALANCE STKCLBALANCE CLOSINGQTY
        closing_value  float              CLOSINGVALUE STKCLOSINGVALUE CLOSINGAMOUNT
        rate           float              CLOSINGRATE RATE
        """,
        {"signed_qty": QUANTITY, "closing_value": MONEY, "rate": QUANTITY},
    ),
    finish=_finish_stock,
)

STOCK_SUMMARY = Section(
    "stock_summary",
    mode="indexed_rows",
    length="name_row",
    index={"name_row": "DSPACCNAME", "info_row": "DSPSTKINFO"},
    required="name",
    fields=fields(
        """
        name           string  name_row/DSPDISPNAME
        quantity_text  string  info_row/DSPSTKCL/DSPCLQTY
        signed_qty     float   info_row/DSPSTKCL/DSPCLQTY
        closing_value  float   info_row/DSPSTKCL/DSPCLAMTA
        rate           float   info_row/DSPSTKCL/DSPCLRATE
        """,
        {"signed_qty": QUANTITY, "closing_value": MONEY, "rate": QUANTITY},
    ),
    finish=_finish_stock_summary,
)

SECTIONS = {
    s.name: s
    for s in (
        COMPANY_INFO,
        ALTER_IDS,
        MANIFEST,
        GROUPS,
        LEDGERS,
        VOUCHERS,
        OUTSTANDING_RECEIVABLES,
        OUTSTANDING_PAYABLES,
        PROFIT_LOSS,
        BALANCE_SHEET,
        TRIAL_BALANCE,
        STOCK_ITEMS,
        STOCK_SUMMARY,
    )
}


def section(name: str) -> Section:
    if name not in SECTIONS:
        raise KeyError(f"no section is defined as {name!r}")
    return SECTIONS[name]


def unknown_sections(responses: DataFrame) -> DataFrame:
    """Landed responses of sections nobody defined; a refresh quarantines them."""
    return responses.filter(~F.col("section").isin(*SECTIONS))
