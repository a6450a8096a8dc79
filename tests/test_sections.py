"""Golden rows for every section, written out of the recorded shapes."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from saldo.functions import scalars as S
from saldo.operators import aggregates as A, merge as G
from saldo.plans import reads
from saldo.sources import responses as R, sections as X
from saldo.sources.bills import bills_by_pattern
from saldo.sources.definitions import Section, fields, read_section, rejected, section_from_json

COUNTERS = "<CMPINFO><COMPANY>0</COMPANY><GROUP>0</GROUP><LEDGER>0</LEDGER><STOCKITEM>0</STOCKITEM><VOUCHER>0</VOUCHER></CMPINFO>"


def collection(body):
    return f"<ENVELOPE><BODY><DESC>{COUNTERS}</DESC><DATA><COLLECTION>{body}</COLLECTION></DATA></BODY></ENVELOPE>"


def messages(*bodies):
    inner = "".join(f"<TALLYMESSAGE>{b}</TALLYMESSAGE>" for b in bodies)
    return f"<ENVELOPE><BODY><IMPORTDATA><REQUESTDATA>{inner}</REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>"


def checked(spark, *texts):
    df = spark.createDataFrame([("c", t) for t in texts], "company_id string, text string")
    return R.check_responses(R.clean_responses(df))


def parse(spark, section, *texts):
    return read_section(checked(spark, *texts), section)


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("pos").select(*names).collect()]


def bill(day, ref, party, amount, due, overdue):
    return (
        f"<BILLFIXED><BILLDATE>{day}</BILLDATE><BILLREF>{ref}</BILLREF><BILLPARTY>{party}</BILLPARTY></BILLFIXED>"
        f"<BILLCL>{amount}</BILLCL><BILLDUE>{due}</BILLDUE><BILLOVERDUE>{overdue}</BILLOVERDUE>"
    )


RECEIVABLES = "<ENVELOPE>" + bill("1-Apr-25", 1, "Birch &amp; Sons", "-412.50", "1-Apr-25", 0) + bill("1-Apr-25", 2, "Quarry Lane Supply", "-8125.40", "1-Apr-25", "12.7") + "</ENVELOPE>"
BILL = ("party_name", "type", "voucher_number", "voucher_date", "due_date", "original_amount", "pending_amount", "days_overdue")
BILL_ROWS = [
    ("Birch & Sons", "receivable", "1", date(2025, 4, 1), date(2025, 4, 1), D("412.50"), D("412.50"), 0),
    ("Quarry Lane Supply", "receivable", "2", date(2025, 4, 1), date(2025, 4, 1), D("8125.40"), D("8125.40"), 12),
]


def test_outstanding(spark):
    found = parse(spark, X.OUTSTANDING_RECEIVABLES, RECEIVABLES)
    assert rows(found, *BILL) == BILL_ROWS
    text = spark.createDataFrame([("c", RECEIVABLES)], "company_id string, text string")
    assert rows(bills_by_pattern(text, "receivable"), *BILL) == BILL_ROWS
    payable = parse(spark, X.OUTSTANDING_PAYABLES, "<ENVELOPE>" + bill("1-Apr-25", "PUR-002", "Delhi", "28000.00", "", "") + bill("1-Apr-25", "x", "", "5", "", "") + "</ENVELOPE>")
    assert rows(payable, *BILL) == [("Delhi", "payable", "PUR-002", date(2025, 4, 1), None, D("28000.00"), D("28000.00"), 0)]
    assert A.party_outstanding_total(found).first()[0] == D("8537.90")


def stock_line(name, qty, rate, value):
    return f"<DSPACCNAME><DSPDISPNAME>{name}</DSPDISPNAME></DSPACCNAME><DSPSTKINFO><DSPSTKCL><DSPCLQTY>{qty}</DSPCLQTY><DSPCLRATE>{rate}</DSPCLRATE><DSPCLAMTA>{value}</DSPCLAMTA></DSPSTKCL></DSPSTKINFO>"


def test_stock_summary(spark):
    doc = "<ENVELOPE>" + stock_line("Brass hinge", " -15 Nos", "", "") + stock_line("Oak plank", "80 Kg", "301.00", "-24080.00") + stock_line("Loose", "40", "1", "-16000.00") + "</ENVELOPE>"
    found = parse(spark, X.STOCK_SUMMARY, doc)
    shown = found.withColumn("status", S.stock_status("closing_qty"))
    assert rows(shown, "name", "group_name", "unit", "closing_qty", "signed_qty", "closing_value", "rate", "status", "is_negative") == [
        ("Brass hinge", "", "Nos", D("15.0000"), D("-15.0000"), D("0.00"), D("0.0000"), "In stock", True),
        ("Oak plank", "", "Kg", D("80.0000"), D("80.0000"), D("24080.00"), D("301.0000"), "In stock", False),
        ("Loose", "", "Nos", D("40.0000"), D("40.0000"), D("16000.00"), D("1.0000"), "In stock", False),
    ]


def test_trial_balance(spark):
    def line(name, debit, credit):
        return f"<DSPACCNAME><DSPDISPNAME>{name}</DSPDISPNAME></DSPACCNAME><DSPACCINFO><DSPCLDRAMT><DSPCLDRAMTA>{debit}</DSPCLDRAMTA></DSPCLDRAMT><DSPCLCRAMT><DSPCLCRAMTA>{credit}</DSPCLCRAMTA></DSPCLCRAMT></DSPACCINFO>"

    doc = "<ENVELOPE>" + line("Current Liabilities", "", "71200.00") + line("Current Assets", "-20450.00", "") + line("Sales Accounts", "", "20450.00") + line("Purchase Accounts", "-71200.00", "") + "</ENVELOPE>"
    found = parse(spark, X.TRIAL_BALANCE, doc)
    assert rows(found, "particulars", "debit", "credit") == [
        ("Current Liabilities", D("0.00"), D("71200.00")), ("Current Assets", D("20450.00"), D("0.00")),
        ("Sales Accounts", D("0.00"), D("20450.00")), ("Purchase Accounts", D("71200.00"), D("0.00")),
    ]
    check = reads.trial_balance(found).totals.first()
    assert (check["debit_total"], check["balanced"]) == (D("91650.00"), True)


PNL = "<ENVELOPE>" + "".join(
    f"<DSPACCNAME><DSPDISPNAME>{n}</DSPDISPNAME></DSPACCNAME><PLAMT><PLSUBAMT>{s}</PLSUBAMT><BSMAINAMT>{m}</BSMAINAMT></PLAMT>"
    for n, s, m in (("Sales Accounts", "", "20450.00"), ("Cost of Sales :", "", "-14150.00"), ("Opening Stock", "", ""),
                    ("Add: Purchase Accounts", "-71200.00", ""), ("Less: Closing Stock", "-48900.00", ""))
) + "</ENVELOPE>"


def test_profit_loss(spark):
    found = parse(spark, X.PROFIT_LOSS, PNL)
    assert rows(found, "particulars", "raw_amount", "amount", "is_debit", "level") == [
        ("Sales Accounts", D("20450.00"), D("20450.00"), True, "main"),
        ("Cost of Sales :", D("-14150.00"), D("14150.00"), False, "main"),
        ("Opening Stock", D("0.00"), D("0.00"), True, "none"),
        ("Add: Purchase Accounts", D("-71200.00"), D("71200.00"), False, "sub"),
        ("Less: Closing Stock", D("-48900.00"), D("48900.00"), False, "sub"),
    ]
    totals = A.pnl_totals(found).first()
    assert (totals["income"], totals["expenses"], totals["profit"], totals["label"]) == (D("20450.00"), D("14150.00"), D("6300.00"), "Net Profit")


def test_balance_sheet(spark):
    def line(name, main="", sub="", debit="", credit=""):
        return (
            f"<DSPACCNAME><DSPDISPNAME>{name}</DSPDISPNAME></DSPACCNAME><BSAMT><BSMAINAMT>{main}</BSMAINAMT><BSSUBAMT>{sub}</BSSUBAMT></BSAMT>"
            f"<DSPACCINFO><DSPCLDRAMT><DSPCLDRAMTA>{debit}</DSPCLDRAMTA></DSPCLDRAMT><DSPCLCRAMT><DSPCLCRAMTA>{credit}</DSPCLCRAMTA></DSPCLCRAMT></DSPACCINFO>"
        )

    doc = "<ENVELOPE>" + line("a", "5") + line("b", "-5") + line("c", "", "7") + line("d", debit="-3") + line("e", credit="4") + line("f") + line("g", "0", "9") + line("") + "</ENVELOPE>"
    assert rows(parse(spark, X.BALANCE_SHEET, doc), "particulars", "amount", "side") == [
        ("a", D("5.00"), "liability"), ("b", D("5.00"), "asset"), ("c", D("7.00"), "liability"), ("d", D("3.00"), "asset"),
        ("e", D("4.00"), "liability"), ("f", D("0.00"), "liability"), ("g", D("0.00"), "asset"),
    ]


VOUCHER = """<VOUCHER VCHTYPE="Sales" REMOTEID="g1"><DATE>20250410</DATE><VOUCHERTYPENAME>Other</VOUCHERTYPENAME><VOUCHERNUMBER>S-001</VOUCHERNUMBER>
<PARTYLEDGERNAME TYPE="String">Harbour Stores</PARTYLEDGERNAME>{amount}<ISCANCELLED>yes</ISCANCELLED>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>Harbour Stores</LEDGERNAME><ISDEEMEDPOSITIVE>Yes</ISDEEMEDPOSITIVE><AMOUNT>-110000</AMOUNT>
<BILLALLOCATIONS.LIST><NAME>S-001</NAME><BILLTYPE>New Ref</BILLTYPE><AMOUNT>-110000</AMOUNT></BILLALLOCATIONS.LIST><BILLALLOCATIONS.LIST>  </BILLALLOCATIONS.LIST></ALLLEDGERENTRIES.LIST>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>Sales</LEDGERNAME><ISDEEMEDPOSITIVE>No</ISDEEMEDPOSITIVE><AMOUNT>110000</AMOUNT>{party}</ALLLEDGERENTRIES.LIST>
<ALLLEDGERENTRIES.LIST><AMOUNT>9</AMOUNT></ALLLEDGERENTRIES.LIST>{items}</VOUCHER>"""
ITEM = '<INVENTORYENTRIES.LIST><STOCKITEMNAME>Drill press</STOCKITEMNAME><ACTUALQTY>-2 NOS</ACTUALQTY><RATE>55000/NOS</RATE><AMOUNT TYPE="Amount">110000</AMOUNT></INVENTORYENTRIES.LIST><INVENTORYENTRIES.LIST/>'


def voucher(amount="", party="", items=ITEM):
    return VOUCHER.format(amount=f"<AMOUNT>{amount}</AMOUNT>" if amount else "", party=party, items=items)


@pytest.mark.parametrize("wrap", [collection, lambda b: messages('<CURRENCY NAME="?"/>', b)], ids=["collection", "messages"])
def test_voucher(spark, wrap):
    found = parse(spark, X.VOUCHERS, wrap(voucher() + "<VOUCHER><DATE>20250410</DATE></VOUCHER>"))
    row = found.collect()
    assert len(row) == 1
    row = row[0]
    assert (row["tally_guid"], row["voucher_type"], row["date"], row["party_name"], row["amount"], row["is_cancelled"], row["view"]) == (
        "g1", "Sales", date(2025, 4, 10), "Harbour Stores", D("110000.00"), True, "",
    )
    assert [tuple(i) for i in row["items"]] == [("Drill press", D("2.0000"), "NOS", D("55000.0000"), D("0.0000"), D("110000.00"), D("-2.0000"))]
    assert [(e["ledger_name"], e["amount"], e["is_party_ledger"], e["is_deemed_positive"], [tuple(b) for b in e["bill_allocations"]]) for e in row["ledger_entries"]] == [
        ("Harbour Stores", D("-110000.00"), False, True, [("S-001", "New Ref", D("-110000.00"))]), ("Sales", D("110000.00"), False, False, []),
    ]
    headers, items, entries = G.split_vouchers(found)
    assert (headers.count(), items.count(), entries.count()) == (1, 1, 2)


@pytest.mark.parametrize(
    "amount,party,items,expected",
    [
        ("-250.5", "", ITEM, "250.50"),
        ("0", "", ITEM + ITEM.replace("110000", "-5"), "110005.00"),
        ("", "<ISPARTYLEDGER>Yes</ISPARTYLEDGER>", "", "110000.00"),
        ("", "", "", "110000.00"),
    ],
)
def test_amount_fallback(spark, amount, party, items, expected):
    assert parse(spark, X.VOUCHERS, collection(voucher(amount, party, items))).first()["amount"] == D(expected)


def test_amount_without_entries(spark):
    assert parse(spark, X.VOUCHERS, collection('<VOUCHER REMOTEID="a"><DATE>20250101</DATE></VOUCHER>')).first()["amount"] == D("0.00")


def test_masters(spark):
    company = '<COMPANY NAME="Demo Co"><BOOKSFROM TYPE="Date">20250401</BOOKSFROM><BOOKSTO>x</BOOKSTO><MASTERID> 29</MASTERID><BASICCOMPANYADDRESS>a</BASICCOMPANYADDRESS><BASICCOMPANYADDRESS>b</BASICCOMPANYADDRESS><STATENAME>&#4; Not Applicable</STATENAME></COMPANY><COMPANY NAME="Second"/>'
    info = parse(spark, X.COMPANY_INFO, collection(company)).collect()
    assert len(info) == 1
    assert (info[0]["name"], info[0]["books_from"], info[0]["books_to"], info[0]["books_to_raw"], info[0]["master_id"], info[0]["address"], info[0]["state"], info[0]["pan"]) == (
        "Demo Co", date(2025, 4, 1), None, "x", 29, "a, b", "Not Applicable", "",
    )
    marks = parse(spark, X.ALTER_IDS, collection('<COMPANY><ALTERID TYPE="Number"> 12</ALTERID><ALTVCHID>x</ALTVCHID><LASTVOUCHERDATE>20250501</LASTVOUCHERDATE></COMPANY>'))
    assert rows(marks, "alter_id", "alt_vch_id", "vch_id", "alt_mst_id", "last_voucher_date") == [("12", "0", "0", "0", date(2025, 5, 1))]
    groups = parse(spark, X.GROUPS, collection('<GROUP NAME="A"><ISREVENUE>Yes</ISREVENUE></GROUP><GROUP><PARENT>x</PARENT></GROUP><GROUP><NAME>B</NAME><PARENT>A</PARENT></GROUP>'))
    assert rows(groups, "name", "parent", "is_revenue", "affects_stock") == [("A", "", "Yes", "No"), ("B", "A", "No", "No")]
    body = '<LEDGER NAME="Cash &amp; Bank"><CLOSINGBALANCE TYPE="Amount">-1,200.50</CLOSINGBALANCE><OPENINGBALANCE>1</OPENINGBALANCE><OPENINGBALANCE>2</OPENINGBALANCE></LEDGER><LEDGER NAME="?"/><LEDGER/>'
    for text in (collection(body), messages(body)):
        assert rows(parse(spark, X.LEDGERS, text), "name", "closing_balance", "opening_balance", "email") == [("Cash & Bank", D("-1200.50"), D("0.00"), "")]
    stock = parse(spark, X.STOCK_ITEMS, collection('<STOCKITEM NAME="W"><CLOSINGBALANCE/><STKCLBALANCE>-15 Kg</STKCLBALANCE><CLOSINGVALUE>-3</CLOSINGVALUE></STOCKITEM>'))
    assert rows(stock, "name", "unit", "closing_qty", "closing_value", "rate", "is_negative") == [("W", "Kg", D("15.0000"), D("3.00"), D("0.0000"), True)]


def test_documents_cut_short_are_rejected(spark):
    whole = collection('<GROUP NAME="A"/>')
    docs = checked(
        spark, whole, whole[:-20], "", "<RESPONSE><LINEERROR>Could not find Report &apos;x&apos;!</LINEERROR></RESPONSE>",
        "<ENVELOPE><STATUS>0</STATUS><DATA>bad <B>x</B></DATA></ENVELOPE>", "<RESPONSE>Unknown Request, cannot be processed</RESPONSE>",
        collection('<GROUP NAME="B&#x2;"/>\x03<GROUP NAME="C&#0007;"/>'),
    )
    assert {r["name"] for r in read_section(docs, X.GROUPS).collect()} == {"A", "B", "C"}
    assert sorted(r["error"].strip() for r in rejected(docs, X.GROUPS).collect()) == sorted([
        "Malformed document", "Malformed document", "Could not find Report 'x'!", "bad  x", "Unknown Request, cannot be processed",
    ])


def test_definitions():
    assert X.section("ledgers") is X.LEDGERS
    with pytest.raises(KeyError):
        X.section("nothing")
    with pytest.raises(ValueError):
        Section("s", fields("a upper A"), rows=("X",))


def test_own_definition(spark):
    own = section_from_json("tax", {"response": {"mode": "list", "row_tag": "TAXUNIT", "fields": {
        "name": {"sources": ["NAME"]}, "from": {"sources": ["GSTDETAILS.LIST.APPLICABLEFROM"], "transform": "date"}}, "required_field": "name"}})
    text = collection("<TAXUNIT><NAME>Default</NAME><GSTDETAILS.LIST><APPLICABLEFROM>20250401</APPLICABLEFROM></GSTDETAILS.LIST></TAXUNIT><TAXUNIT/>")
    assert rows(parse(spark, own, text), "name", "from") == [("Default", date(2025, 4, 1))]


def test_longest_list_counts_without_length_source(spark):
    own = Section("x", mode="indexed_rows", index={"a": "A", "b": "B"}, fields=fields("a string a\nb int b"))
    found = parse(spark, own, "<ENVELOPE><A>1</A><A></A><B>7</B><B>8</B><B>9</B></ENVELOPE>")
    assert rows(found, "a", "b") == [("1", 7), ("", 8), ("", 9)]


def test_company_names(spark):
    df = spark.createDataFrame([(1, '<COMPANY NAME=" A "/><COMPANY X="1" NAME="A"/><NAME>no</NAME>'), (2, "<NAME TYPE=\"String\">B</NAME><NAME> </NAME>")], "id int, text string")
    assert [tuple(r) for r in R.company_names(df).orderBy("id", "pos").select("id", "name").collect()] == [(1, "A"), (1, "A"), (2, "B")]


def test_empty_section_keeps_no_rows(spark):
    assert parse(spark, X.LEDGERS, collection("")).count() == 0
    assert parse(spark, X.PROFIT_LOSS, "<ENVELOPE></ENVELOPE>").count() == 0
    assert parse(spark, X.GROUPS, collection("<LEDGER NAME='x'/>")).filter(F.lit(True)).count() == 0
