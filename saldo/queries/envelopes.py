"""Envelopes derived from the ledger tables, so that the ingest queries parse data that grows with them.

Rows are dealt into envelopes of some hundred by their key; an envelope is the unit a task parses. The forms vary
by envelope the way exports do: encodings, collection and message paths, attributed tags, grouped digits,
illegal references, counters that share row tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saldo.operators import joins as J
from saldo.queries.model import Model

ROWS = 100
#: Rows of an envelope that is landed as a file of its own, some MB; files of a few KB take longer to open than to read.
FILE_ROWS = 10_000


def chunk(key, rows: int = ROWS) -> Column:
    return F.floor((F.col(key) if isinstance(key, str) else key).cast("bigint") / rows)


def esc(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def tag(name: str, value: Column | str, attributes: str = "") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"<{name}{attributes}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{name}>"))


def digits(amount) -> Column:
    """Two decimals with grouped digits, e.g. 1,234.50."""
    return F.format_number(F.col(amount) if isinstance(amount, str) else amount, 2)


def envelopes(rows: DataFrame, by: list[str], xml: Column, opening: Column, closing: Column) -> DataFrame:
    """One envelope per value of ``by``; the rows of an envelope come in the order of their text.

    What follows is parsed in the tasks of this shuffle. Their number is given, as adaptive execution would merge them by
    the compressed size of the rows, to fewer tasks of uneven size than there are cores.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return (
        rows.select(*by, xml.alias("xml"))
        .repartition(tasks, *by)
        .groupBy(*by)
        .agg(F.array_join(F.sort_array(F.collect_list("xml")), "\n").alias("rows"))
        .withColumn("text", F.concat(F.lit("<ENVELOPE>"), opening, "rows", closing, F.lit("</ENVELOPE>")))
        .drop("rows")
    )


COUNTERS = "<CMPINFO><COMPANY>0</COMPANY><GROUP>0</GROUP><LEDGER>0</LEDGER><STOCKITEM>0</STOCKITEM><VOUCHER>0</VOUCHER></CMPINFO>"
COLLECTION_OPEN = f"<HEADER><STATUS>1</STATUS></HEADER><BODY><DESC>{COUNTERS}</DESC><DATA><COLLECTION>"
COLLECTION_CLOSE = "</COLLECTION></DATA></BODY>"


def collection(rows: DataFrame, by: list[str], xml: Column) -> DataFrame:
    return envelopes(rows, by, xml, F.lit(COLLECTION_OPEN), F.lit(COLLECTION_CLOSE))


def either_path(rows: DataFrame, by: list[str], xml: Column) -> DataFrame:
    """Envelopes with an odd chunk carry their rows in the message form, led by a currency."""
    odd = F.pmod(F.col("chunk"), F.lit(2)) == 1
    message = F.when(odd, F.concat(F.lit("<TALLYMESSAGE>"), xml, F.lit("</TALLYMESSAGE>"))).otherwise(xml)
    lead = "<BODY><IMPORTDATA><REQUESTDATA><TALLYMESSAGE><CURRENCY NAME=\"?\"/></TALLYMESSAGE>"
    return envelopes(
        rows,
        by,
        message,
        F.when(odd, F.lit(lead)).otherwise(F.lit(COLLECTION_OPEN)),
        F.when(odd, F.lit("</REQUESTDATA></IMPORTDATA></BODY>")).otherwise(F.lit(COLLECTION_CLOSE)),
    )


def report(rows: DataFrame, by: list[str], xml: Column) -> DataFrame:
    return envelopes(rows, by, xml, F.lit(""), F.lit(""))


def encoded(docs: DataFrame) -> DataFrame:
    """Bytes as they land: UTF-8, UTF-16 with either mark, or UTF-16 without one, by envelope."""
    text = F.col("text")
    form = F.pmod(F.col("chunk"), F.lit(4))
    content = (
        F.when(form == 0, F.encode(text, "UTF-8"))
        .when(form == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(form == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))
        .otherwise(F.encode(text, "UTF-16LE"))
    )
    return docs.withColumn("content", content).withColumn("content_type", F.lit(None).cast("string")).drop("text")


# ---- one builder per section ------------------------------------------------------------------------------


def vouchers(m: Model, per: int = ROWS) -> DataFrame:
    """Vouchers with items and ledger entries; the header amount is left out where items or entries give it."""
    money_attr = ' TYPE="Amount"'
    item = F.concat(
        F.lit("<ALLINVENTORYENTRIES.LIST>"),
        tag("STOCKITEMNAME", esc("stock_item_name")),
        tag("ACTUALQTY", F.concat(F.lit(" -"), F.col("quantity").cast("bigint").cast("string"), F.lit(" Nos"))),
        tag("RATE", F.concat(digits("rate"), F.lit("/Nos"))),
        tag("DISCOUNT", "discount_pct"),
        tag("AMOUNT", "amount", money_attr),
        F.lit("</ALLINVENTORYENTRIES.LIST>"),
    )
    # The text comes last in an item, whose order it leaves alone; it is written before the items are gathered, as Spark
    # compiles no expression over the entries of an array.
    items = m.items.withColumn("xml", item)
    rows = J.vouchers_with_items(m.vouchers, items, page_rows=None, only="xml")  # a voucher is one element
    party = F.concat(
        F.lit("<LEDGERENTRIES.LIST>"),
        tag("LEDGERNAME", esc("party_name")),
        F.lit("<ISPARTYLEDGER>Yes</ISPARTYLEDGER><ISDEEMEDPOSITIVE>Yes</ISDEEMEDPOSITIVE>"),
        tag("AMOUNT", F.concat(F.lit("-"), digits("amount")), money_attr),
        F.lit("<BILLALLOCATIONS.LIST>"),
        tag("NAME", "voucher_number"),
        F.lit("<BILLTYPE>New Ref</BILLTYPE>"),
        tag("AMOUNT", digits("amount")),
        F.lit("</BILLALLOCATIONS.LIST><BILLALLOCATIONS.LIST/></LEDGERENTRIES.LIST>"),
    )
    account = F.concat(
        F.lit("<LEDGERENTRIES.LIST>"),
        tag("LEDGERNAME", F.concat("voucher_type", F.lit(" Account"))),
        F.lit("<ISPARTYLEDGER>No</ISPARTYLEDGER>"),
        tag("AMOUNT", digits("amount")),
        F.lit("</LEDGERENTRIES.LIST><LEDGERENTRIES.LIST><AMOUNT>1</AMOUNT></LEDGERENTRIES.LIST>"),
    )
    header_amount = F.when(F.col("voucher_type") != "Payment", F.concat(F.lit("-"), digits("amount"))).otherwise("")
    xml = F.concat(
        F.lit('<VOUCHER REMOTEID="'), "tally_guid", F.lit('" VCHTYPE="'), "voucher_type", F.lit('" OBJVIEW="Listed">'),
        tag("DATE", F.date_format("date", "yyyyMMdd")),
        tag("VOUCHERNUMBER", "voucher_number"),
        tag("PARTYLEDGERNAME", esc("party_name"), ' TYPE="String"'),
        tag("AMOUNT", header_amount, money_attr),
        tag("NARRATION", F.concat(F.lit("&#4; "), esc("narration"), F.lit("\x02"))),
        tag("ISCANCELLED", F.when(F.col("is_cancelled"), "Yes").otherwise("No")),
        tag("ISOPTIONAL", F.when(F.col("is_optional"), "Yes").otherwise("No")),
        tag("REFERENCE", "reference"),
        tag("ISINVOICE", F.when(F.col("is_invoice"), "Yes").otherwise("No")),
        F.array_join("items", ""),
        party,
        account,
        F.lit("</VOUCHER>"),
    )
    rows = rows.withColumn("chunk", chunk("tally_guid", per))
    return encoded(either_path(rows, ["company_id", "chunk"], xml))


def ledgers(m: Model, per: int = ROWS) -> DataFrame:
    """Debtors carry their name as an attribute, creditors as a tag; nameless and ``?`` rows are mixed in."""
    debtor = F.col("group_name") == "Sundry Debtors"
    xml = F.concat(
        F.when(debtor, F.concat(F.lit('<LEDGER NAME="'), esc("name"), F.lit('">'))).otherwise(
            F.concat(F.lit("<LEDGER>"), tag("NAME", esc("name"), ' TYPE="String"'))
        ),
        tag("PARENT", "group_name", ' TYPE="String"'),
        tag("OPENINGBALANCE", F.lit("")),
        tag("CLOSINGBALANCE", F.concat(digits("closing_balance"), F.lit(" Dr")), ' TYPE="Amount"'),
        tag("MASTERID", F.concat(F.lit(" "), F.col("master_id").cast("string"))),
        tag("LEDSTATENAME", F.concat(F.lit("&#x4; "), "state")),
        tag("COUNTRYNAME", "country"),
        tag("GUID", "guid"),
        F.lit('</LEDGER><LEDGER NAME="?"/><LEDGER><PARENT>nameless</PARENT></LEDGER>'),
    )
    rows = m.ledgers.withColumn("chunk", chunk("master_id", per))
    return encoded(either_path(rows, ["company_id", "chunk"], xml))


def groups(m: Model) -> DataFrame:
    top = F.col("parent") == ""
    xml = F.concat(
        F.lit('<GROUP NAME="'), esc("name"), F.lit('">'),
        tag("PARENT", "parent"),
        tag("MASTERID", "master_id", ' TYPE="Number"'),
        F.when(top, "<ISREVENUE>Yes</ISREVENUE>").otherwise("<ISREVENUE/>"),
        F.lit("</GROUP>"),
    )
    rows = m.groups.withColumn("chunk", chunk("master_id"))
    return encoded(collection(rows, ["company_id", "chunk"], xml))


def companies(m: Model) -> DataFrame:
    """One company document per customer, taken as a company of its own; a second company follows each."""
    rows = m.customers.select(
        F.col("c_custkey").alias("chunk"), F.col("c_name").alias("name"), "n_name", "r_name", "c_custkey"
    )
    xml = F.concat(
        F.lit('<COMPANY NAME="'), esc("name"), F.lit('"><NAME/><BOOKSFROM TYPE="Date">20250401</BOOKSFROM><BOOKSTO>31-Mar-26</BOOKSTO>'),
        tag("GUID", F.concat(F.lit("G-"), F.col("c_custkey").cast("string"))),
        tag("MASTERID", F.concat(F.lit(" "), F.col("c_custkey").cast("string"))),
        tag("BASICCOMPANYADDRESS", F.lit("1 Main Road")), tag("BASICCOMPANYADDRESS", "n_name"),
        tag("STATENAME", F.concat(F.lit("&#4; "), "n_name")), tag("COUNTRYNAME", "r_name"),
        F.lit('</COMPANY><COMPANY NAME="Other"><NAME>Other</NAME></COMPANY>'),
    )
    return encoded(collection(rows, ["chunk"], xml))


def alter_ids(m: Model) -> DataFrame:
    rows = m.markers(cached=False).withColumn("chunk", F.col("company_id").cast("bigint"))
    xml = F.concat(
        F.lit('<COMPANY NAME="x">'),
        tag("ALTERID", F.concat(F.lit(" "), "alter_id"), ' TYPE="Number"'),
        tag("ALTVCHID", "alt_vch_id"), tag("CMPVCHID", "vch_id"), tag("ALTMSTID", F.concat("alt_mst_id", F.lit(" Masters"))),
        tag("LASTVOUCHERDATE", F.date_format("last_voucher_date", "yyyyMMdd")),
        F.lit("</COMPANY>"),
    )
    return encoded(collection(rows, ["company_id", "chunk"], xml))


def stock_items(m: Model) -> DataFrame:
    xml = F.concat(
        F.lit('<STOCKITEM NAME="'), esc("name"), F.lit('">'),
        tag("PARENT", "group_name"),
        F.when(F.col("signed_qty") >= 0, "<BASEUNITS>Nos</BASEUNITS>").otherwise(""),
        tag("CLOSINGBALANCE", F.concat(F.col("signed_qty").cast("bigint").cast("string"), F.lit(" Nos"))),
        tag("CLOSINGVALUE", F.concat(F.lit("-"), digits("closing_value")), ' TYPE="Amount"'),
        tag("CLOSINGRATE", F.concat(digits("rate"), F.lit("/Nos"))),
        F.lit("</STOCKITEM>"),
    )
    rows = m.stock.withColumn("chunk", chunk("p_partkey"))
    return encoded(collection(rows, ["company_id", "chunk"], xml))


def stock_summary(m: Model) -> DataFrame:
    """The display report: names and figures as sibling runs, without group or attributes."""
    xml = F.concat(
        F.lit("<DSPACCNAME>"), tag("DSPDISPNAME", esc("name")), F.lit("</DSPACCNAME><DSPSTKINFO><DSPSTKCL>"),
        tag("DSPCLQTY", F.concat(F.col("signed_qty").cast("bigint").cast("string"), F.lit(" Pcs"))),
        tag("DSPCLRATE", "rate"), tag("DSPCLAMTA", F.concat(F.lit("-"), F.col("closing_value").cast("string"))),
        F.lit("</DSPSTKCL></DSPSTKINFO>"),
    )
    rows = m.stock.withColumn("chunk", chunk("p_partkey"))
    return encoded(report(rows, ["company_id", "chunk"], xml))


def bills(rows: DataFrame, sign: str) -> DataFrame:
    xml = F.concat(
        F.lit("<BILLFIXED>"),
        tag("BILLDATE", F.date_format("voucher_date", "d-MMM-yy")),
        tag("BILLREF", "voucher_number"),
        tag("BILLPARTY", esc("party_name")),
        F.lit("</BILLFIXED>"),
        tag("BILLCL", F.concat(F.lit(sign), F.col("pending_amount").cast("string"))),
        tag("BILLDUE", F.date_format("due_date", "d-MMM-yy")),
        tag("BILLOVERDUE", F.when(F.col("days_overdue") > 0, F.concat(F.col("days_overdue").cast("string"), F.lit(".7")))),
    )
    return encoded(report(rows.withColumn("chunk", chunk("bill_key")), ["company_id", "chunk"], xml))


def profit_loss(m: Model) -> DataFrame:
    amount = F.col("raw_amount").cast("string")
    xml = F.concat(
        F.lit("<DSPACCNAME>"), tag("DSPDISPNAME", "particulars"), F.lit("</DSPACCNAME><PLAMT>"),
        tag("PLSUBAMT", F.when(F.col("level") == "sub", amount)),
        tag("BSMAINAMT", F.when(F.col("level") == "main", amount)),
        F.lit("</PLAMT>"),
    )
    rows = m.profit_loss.withColumn("chunk", F.substring("month", 1, 4).cast("bigint"))
    return encoded(report(rows, ["company_id", "chunk"], xml))


def balance_sheet(m: Model) -> DataFrame:
    xml = F.concat(
        F.lit("<DSPACCNAME>"), tag("DSPDISPNAME", "particulars"), F.lit("</DSPACCNAME><BSAMT>"),
        tag("BSMAINAMT", "main"), tag("BSSUBAMT", "sub"),
        F.lit("</BSAMT><DSPACCINFO><DSPCLDRAMT>"), tag("DSPCLDRAMTA", "debit"),
        F.lit("</DSPCLDRAMT></DSPACCINFO>"),
    )
    rows = m.balance_sheet.withColumn("chunk", F.length("particulars").cast("bigint"))
    return encoded(report(rows, ["company_id", "chunk"], xml))


def trial_balance(m: Model) -> DataFrame:
    xml = F.concat(
        F.lit("<DSPACCNAME>"), tag("DSPDISPNAME", esc("particulars")), F.lit("</DSPACCNAME><DSPACCINFO><DSPCLDRAMT>"),
        tag("DSPCLDRAMTA", F.when(F.col("debit") != 0, F.concat(F.lit("-"), digits("debit")))),
        F.lit("</DSPCLDRAMT><DSPCLCRAMT>"), tag("DSPCLCRAMTA", digits("credit")),
        F.lit("</DSPCLCRAMT></DSPACCINFO>"),
    )
    # Ledger names end in their number; accounts, of which there are five per company, share chunk 0.
    number = F.coalesce(F.regexp_extract("particulars", r"(\d+)$", 1).try_cast("bigint"), F.lit(0))
    rows = m.trial_balance.withColumn("chunk", chunk(number))
    return encoded(report(rows, ["company_id", "chunk"], xml))
