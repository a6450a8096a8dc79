"""Ingest queries: envelopes derived from the tables, decoded, cleaned, checked and parsed back into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saldo.operators import merge as G
from saldo.queries import envelopes as E
from saldo.queries.model import Model, plain, sql
from saldo.queries.relational import HEADER
from saldo.session import new_folder
from saldo.sources import captures, responses as R, sections as D
from saldo.sources.definitions import (
    Section,
    fields,
    read_section,
    section_from_json,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, build, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, folder: plain(build(Model(spark, folder)))
    if oracle:
        ORACLE[name] = oracle


def parsed(responses: DataFrame, section: Section) -> DataFrame:
    return read_section(R.prepare(responses), section)


# ---- responses -------------------------------------------------------------------------------------------


def document_bytes(m: Model) -> DataFrame:
    """Every document as an envelope in one of four encodings, by language."""
    docs = m.table("documents").select(
        "doc_id", F.concat(F.lit("<ENVELOPE>"), "text", F.lit("</ENVELOPE>")).alias("text"),
        F.pmod(F.length("lang") + F.length("source"), F.lit(4)).alias("chunk"),
    )
    return E.encoded(docs)


register(
    "src_decode_response",
    lambda m: R.decode_responses(document_bytes(m)).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest")),
    """SELECT doc_id, length('<ENVELOPE>' || text || '</ENVELOPE>') AS n, md5('<ENVELOPE>' || text || '</ENVELOPE>') AS digest
    FROM documents""",
)
register(
    "src_clean_xml",
    lambda m: R.clean_responses(
        m.table("documents").select(
            "doc_id", F.concat(F.lit("a\x01\x1f&#4;&#x1F;&#10;&#65;"), "text", F.lit("\x0b&#0031;&#xa;")).alias("text")
        )
    ).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest")),
    r"""SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
      'a&#10;&#65;' || text || '&#xa;', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'),
      '&#0*([0-8]|11|12|1[4-9]|2[0-9]|3[01]);', '', 'g'), '&#[xX]0*([0-8bBcCeEfF]|1[0-9a-fA-F]);', '', 'g') AS t FROM documents)""",
)


def answers(m: Model) -> DataFrame:
    """A response per order: usable, or one of the ways to report failure, by status and priority."""
    number = F.col("o_orderkey").cast("string")
    return m.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("<ENVELOPE><HEADER><STATUS>1</STATUS></HEADER><ROW><STATUS>0</STATUS>"), number, F.lit("</ROW></ENVELOPE>")))
        .when(
            F.col("o_orderpriority") == "1-URGENT",
            F.concat(F.lit("<RESPONSE><LINEERROR>Could not find Report &apos;"), number, F.lit("&apos;!</LINEERROR></RESPONSE>")),
        )
        .when(
            F.col("o_orderpriority") == "2-HIGH",
            F.concat(F.lit("<ENVELOPE><STATUS> 0 </STATUS><DATA><B>no</B> "), number, F.lit("</DATA></ENVELOPE>")),
        )
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("<ENVELOPE><STATUS>0</STATUS></ENVELOPE>"))
        .otherwise("<RESPONSE>Unknown Request, cannot be processed</RESPONSE>")
        .alias("text"),
    )


register(
    "src_check_response",
    lambda m: R.check_responses(answers(m)).select("o_orderkey", F.trim("error").alias("error")),
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL
      WHEN o_orderpriority = '1-URGENT' THEN 'Could not find Report ''' || o_orderkey || '''!'
      WHEN o_orderpriority = '2-HIGH' THEN 'no  ' || o_orderkey WHEN o_orderpriority = '3-MEDIUM' THEN 'Unknown error'
      ELSE 'Unknown Request, cannot be processed' END AS error FROM orders""",
)


def landed(m: Model) -> DataFrame:
    """Ledger envelopes written as files by company and section, then scanned back with their folders."""
    folder = new_folder(m.spark, "landing")
    docs = R.decode_responses(E.ledgers(m))
    (
        docs.select(
            F.col("company_id").alias("company"), F.lit("ledgers").alias("section"), F.lit("20250401").alias("fetched_at"),
            F.regexp_replace("text", r"[\r\n]", " ").alias("value"),
        )
        .write.partitionBy("company", "section", "fetched_at")
        .option("maxRecordsPerFile", 1)
        .text(folder)
    )
    return parsed(R.read_landing(m.spark, folder), D.LEDGERS)


LEDGER_SQL = """SELECT company_id, name, group_name, CAST(closing_balance AS DOUBLE) AS closing_balance, master_id, state, country, guid
FROM ledgers"""
LEDGER_COLUMNS = ["company_id", "name", "group_name", "closing_balance", "master_id", "state", "country", "guid"]
register("src_landing_files", lambda m: landed(m).select(*LEDGER_COLUMNS), sql(LEDGER_SQL))

# ---- row places ------------------------------------------------------------------------------------------

NAMES = Section("names", rows=("BODY/DATA/COLLECTION/GROUP",), required="name", fields=fields("name string NAME @NAME\nparent string PARENT"))
register(
    "src_collection_rows",
    lambda m: parsed(E.groups(m), NAMES).select("company_id", "name", "parent"),
    sql("SELECT company_id, name, parent FROM acct_groups"),
)
MESSAGE_LEDGERS = Section("message_ledgers", rows=("messages/LEDGER",), required="name", fields=fields("name string NAME @NAME\nguid string GUID"), keep=D.LEDGERS.keep)
register(
    "src_message_rows",
    lambda m: parsed(E.ledgers(m), MESSAGE_LEDGERS).select("company_id", "name", "guid"),
    sql(f"SELECT company_id, name, guid FROM ledgers WHERE (master_id // {E.ROWS}) % 2 = 1"),
)
GUIDS = Section("guids", rows=D.VOUCHERS.rows, required="tally_guid", fields=fields("tally_guid string @REMOTEID GUID"))
register(
    "src_row_path_options",
    lambda m: parsed(E.vouchers(m), GUIDS).select("company_id", "tally_guid"),
    sql("SELECT company_id, tally_guid FROM vouchers"),
)
INDEXED = Section(
    "indexed", mode="indexed_rows", length="bill", index={"bill": "BILLFIXED", "due": "BILLDUE"}, required="ref",
    fields=fields("ref string bill/BILLREF\ndue date due"),
)
register(
    "src_indexed_rows",
    lambda m: parsed(E.bills(m.payables, ""), INDEXED).select("company_id", "ref", "due"),
    sql("SELECT company_id, voucher_number AS ref, CAST(due_date AS VARCHAR) AS due FROM payables"),
)


def bill_regex(m: Model) -> DataFrame:
    """Adjacent quadruples found in the text itself, for reports whose lists do not line up."""
    from saldo.sources.bills import bills_by_pattern

    return bills_by_pattern(R.usable(R.prepare(E.bills(m.receivables, "-"))), "receivable")


BILL_SQL = """SELECT company_id, party_name, type, voucher_number, CAST(voucher_date AS VARCHAR) AS voucher_date,
  CAST(due_date AS VARCHAR) AS due_date, CAST(original_amount AS DOUBLE) AS original_amount,
  CAST(pending_amount AS DOUBLE) AS pending_amount, CAST(days_overdue AS BIGINT) AS days_overdue"""
BILL_COLUMNS = ["company_id", "party_name", "type", "voucher_number", "voucher_date", "due_date", "original_amount", "pending_amount", "days_overdue"]
register("src_outstanding_regex", lambda m: bill_regex(m).select(*BILL_COLUMNS), sql(f"{BILL_SQL} FROM receivables"))

JSON_DEFINITION = """{"response": {"mode": "list", "row_tag": "STOCKITEM", "required_field": "item",
  "fields": {"item": {"sources": ["NAME", "@NAME"]},
             "brand": {"sources": ["PARENT"], "transform": "string", "default": "none"},
             "quantity": {"sources": ["CLOSINGBALANCE"], "transform": "quantity_value_abs"},
             "unit": {"sources": ["BASEUNITS"], "transform": "quantity_unit", "default": "Pcs"}}}}"""
register(
    "src_section_definition",
    lambda m: parsed(E.stock_items(m), section_from_json("own_stock", JSON_DEFINITION)).select("company_id", "item", "brand", "quantity", "unit"),
    sql(
        """SELECT company_id, name AS item, group_name AS brand, CAST(closing_qty AS DOUBLE) AS quantity,
        CASE WHEN signed_qty >= 0 THEN 'Nos' ELSE 'Pcs' END AS unit FROM stock"""
    ),
)

# ---- captures --------------------------------------------------------------------------------------------


def blobs(m: Model) -> DataFrame:
    """Capture blobs of some requests each, derived from orders: kind by priority, packet bytes after each body."""
    number = F.col("o_orderkey").cast("string")
    kind = F.substring("o_orderpriority", 1, 1)
    head = F.when(kind.isin("1", "2"), "Function").when(kind.isin("3", "4"), "Collection").otherwise("Data")
    name = (
        F.when(kind == "1", "$$LicenseInfo").when(kind == "2", "$$ProdInfo").when(kind == "3", "AllVouchers")
        .when(kind == "4", "TaxUnits").otherwise("Statistics")
    )
    body = F.concat(
        F.lit("<ENVELOPE><HEADER>"), E.tag("TYPE", head), E.tag("ID", name), F.lit("</HEADER><BODY><DESC>"),
        E.tag("SVCURRENTCOMPANY", F.concat(F.lit("Größe "), number)),
        F.when(kind == "3", "<COLLECTION NAME=\"x\"><TYPE>Voucher</TYPE><FETCH>GUID, DATE,AMOUNT</FETCH></COLLECTION>")
        .when(kind == "4", "<COLLECTION NAME=\"x\"><TYPE>TaxUnit</TYPE><COMPUTE>A:$B</COMPUTE><COMPUTE> C: $D </COMPUTE></COLLECTION>")
        .otherwise(""),
        F.lit("</DESC></BODY></ENVELOPE>"),
    )
    request = F.concat(
        F.encode(F.lit("POST / HTTP/1.1\r\nHost: x\r\n\r\n"), "UTF-8"),
        F.encode(body, "UTF-16LE"),
        F.unhex(F.lit("00D80AD8FF")),
    )
    rows = m.table("orders").select(E.chunk("o_orderkey").alias("chunk"), "o_orderkey", F.hex(request).alias("bytes"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "bytes"))), lambda r: r["bytes"]), "")
    noise = F.unhex(F.lit("D4C3B2A1"))
    return rows.groupBy("chunk").agg(F.concat(noise, F.unhex(joined)).alias("content"))


def described(m: Model) -> DataFrame:
    return captures.describe_requests(captures.extract_envelopes(blobs(m)))


REQUEST_SQL = f"""requests AS (
  SELECT o_orderkey // {E.ROWS} AS chunk, row_number() OVER (PARTITION BY o_orderkey // {E.ROWS} ORDER BY o_orderkey) AS seq,
    'Größe ' || o_orderkey AS company,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'Function' WHEN o_orderpriority[1] IN ('3', '4') THEN 'Collection' ELSE 'Data' END AS type,
    CASE o_orderpriority[1] WHEN '1' THEN '$$LicenseInfo' WHEN '2' THEN '$$ProdInfo' WHEN '3' THEN 'AllVouchers' WHEN '4' THEN 'TaxUnits'
      ELSE 'Statistics' END AS id,
    CASE o_orderpriority[1] WHEN '3' THEN 'Voucher' WHEN '4' THEN 'TaxUnit' END AS object_type,
    CASE o_orderpriority[1] WHEN '3' THEN 'GUID|DATE|AMOUNT' ELSE '' END AS fetched,
    CASE o_orderpriority[1] WHEN '4' THEN 'A:$B|C: $D' ELSE '' END AS computed FROM orders)"""
register(
    "src_extract_envelopes",
    lambda m: described(m).select(
        "chunk", F.col("seq").cast("bigint").alias("seq"), "company", "type", "id", "object_type",
        F.array_join("fetch", "|").alias("fetched"), F.array_join("compute", "|").alias("computed"),
    ),
    f"WITH {REQUEST_SQL} SELECT * FROM requests",
)
register(
    "agg_request_profile",
    lambda m: captures.request_profile(described(m)),
    f"WITH {REQUEST_SQL} SELECT type, id, count(*) AS requests FROM requests GROUP BY 1, 2",
)
register(
    "proj_company_names",
    lambda m: R.company_names(R.decode_responses(E.companies(m))).select("chunk", F.col("pos").cast("bigint").alias("pos"), "name"),
    "SELECT c_custkey AS chunk, 0 AS pos, c_name AS name FROM customer UNION ALL SELECT c_custkey, 1, 'Other' FROM customer",
)

# ---- sections --------------------------------------------------------------------------------------------

register(
    "sec_company_info",
    lambda m: parsed(E.companies(m), D.COMPANY_INFO).select(
        "name", "books_from", "books_to", "books_from_raw", "books_to_raw", "guid", "master_id", "address", "state", "country", "pan"
    ),
    sql(
        """SELECT c_name AS name, '2025-04-01' AS books_from, '2026-03-31' AS books_to, '20250401' AS books_from_raw, '31-Mar-26' AS books_to_raw,
        'G-' || c_custkey AS guid, c_custkey AS master_id, '1 Main Road, ' || n_name AS address, n_name AS state, r_name AS country, '' AS pan
        FROM customers"""
    ),
)
register(
    "sec_alter_ids",
    lambda m: parsed(E.alter_ids(m), D.ALTER_IDS).select("company_id", "alter_id", "alt_vch_id", "vch_id", "alt_mst_id", "last_voucher_date"),
    sql("SELECT company_id, alter_id, alt_vch_id, vch_id, alt_mst_id, CAST(last_voucher_date AS VARCHAR) AS last_voucher_date FROM current_markers"),
)
register(
    "sec_groups",
    lambda m: parsed(E.groups(m), D.GROUPS).select("company_id", "name", "parent", "master_id", "is_revenue", "affects_stock", "is_subledger"),
    sql(
        """SELECT company_id, name, parent, master_id, CASE WHEN parent = '' THEN 'Yes' ELSE 'No' END AS is_revenue,
        'No' AS affects_stock, 'No' AS is_subledger FROM acct_groups"""
    ),
)
register(
    "sec_ledgers",
    lambda m: parsed(E.ledgers(m), D.LEDGERS).select(*LEDGER_COLUMNS, "opening_balance", "email"),
    sql(LEDGER_SQL.replace("guid\n", "guid, 0.0::DOUBLE AS opening_balance, '' AS email\n")),
)
VOUCHER_COLUMNS = ["company_id", "tally_guid", "voucher_number", "voucher_type", "date", "party_name", "narration", "is_cancelled", "reference", "is_invoice", "view"]
# The amount of a payment is left out of its header, so it comes from the items or the party entry.
AMOUNT_SQL = "CAST(CASE WHEN voucher_type = 'Payment' THEN coalesce(i.t, v.amount) ELSE v.amount END AS DOUBLE)"
register(
    "sec_vouchers",
    lambda m: parsed(E.vouchers(m), D.VOUCHERS).select(
        *VOUCHER_COLUMNS, "amount", F.size("items").alias("item_count"), F.size("ledger_entries").alias("entry_count")
    ),
    sql(
        f"""SELECT v.company_id, v.tally_guid, voucher_number, voucher_type, CAST(date AS VARCHAR) AS date, party_name, narration, is_cancelled,
        reference, is_invoice, 'Listed' AS view, {AMOUNT_SQL} AS amount, coalesce(i.n, 0) AS item_count, 2 AS entry_count
        FROM vouchers v LEFT JOIN (SELECT company_id, tally_guid, count(*) AS n, sum(amount) AS t FROM items GROUP BY 1, 2) i
        USING (company_id, tally_guid)"""
    ),
)
register(
    "agg_voucher_amount_fallback",
    lambda m: parsed(E.vouchers(m), D.VOUCHERS).filter(F.col("voucher_type") == "Payment").select("company_id", "tally_guid", "amount"),
    sql(
        f"""SELECT v.company_id, v.tally_guid, {AMOUNT_SQL} AS amount FROM vouchers v
        LEFT JOIN (SELECT company_id, tally_guid, sum(amount) AS t FROM items GROUP BY 1, 2) i USING (company_id, tally_guid)
        WHERE voucher_type = 'Payment'"""
    ),
)


def split(m: Model):
    return G.split_vouchers(parsed(E.vouchers(m), D.VOUCHERS))


ITEM_SQL = """SELECT company_id, tally_guid, stock_item_name, CAST(quantity AS DOUBLE) AS quantity, unit, CAST(rate AS DOUBLE) AS rate,
  CAST(discount_pct AS DOUBLE) AS discount_pct, CAST(amount AS DOUBLE) AS amount"""
ITEM_COLUMNS = ["company_id", "tally_guid", "stock_item_name", "quantity", "unit", "rate", "discount_pct", "amount"]
register(
    "sec_voucher_items",
    lambda m: split(m)[1].select(*ITEM_COLUMNS, "signed_quantity"),
    sql(f"{ITEM_SQL}, CAST(-quantity AS DOUBLE) AS signed_quantity FROM items"),
)
ENTRY_SQL = "SELECT company_id, tally_guid, ledger_name, CAST(amount AS DOUBLE) AS amount, is_party_ledger, is_deemed_positive"
ENTRY_COLUMNS = ["company_id", "tally_guid", "ledger_name", "amount", "is_party_ledger", "is_deemed_positive"]
register(
    "sec_ledger_entries",
    lambda m: split(m)[2].select(*ENTRY_COLUMNS, F.size("bill_allocations").alias("bills")),
    sql(f"{ENTRY_SQL}, CASE WHEN bill_name IS NULL THEN 0 ELSE 1 END AS bills FROM entries"),
)
register(
    "sec_bill_allocations",
    lambda m: split(m)[2].select("company_id", "tally_guid", F.explode("bill_allocations").alias("b")).select("company_id", "tally_guid", "b.*"),
    sql("SELECT company_id, tally_guid, bill_name AS name, 'New Ref' AS bill_type, CAST(-amount AS DOUBLE) AS amount FROM entries WHERE bill_name IS NOT NULL"),
)
register(
    "sec_stock_items",
    lambda m: parsed(E.stock_items(m), D.STOCK_ITEMS).select(
        "company_id", "name", "group_name", "unit", "closing_qty", "signed_qty", "closing_value", "rate", "is_negative"
    ),
    sql(
        """SELECT company_id, name, group_name, unit, CAST(closing_qty AS DOUBLE) AS closing_qty, CAST(signed_qty AS DOUBLE) AS signed_qty,
        CAST(closing_value AS DOUBLE) AS closing_value, CAST(rate AS DOUBLE) AS rate, signed_qty < 0 AS is_negative FROM stock"""
    ),
)
register(
    "sec_stock_summary",
    lambda m: parsed(E.stock_summary(m), D.STOCK_SUMMARY).select(
        "company_id", "name", "group_name", "unit", "closing_qty", "closing_value", "rate"
    ),
    sql(
        """SELECT company_id, name, '' AS group_name, 'Pcs' AS unit, CAST(closing_qty AS DOUBLE) AS closing_qty,
        CAST(closing_value AS DOUBLE) AS closing_value, CAST(rate AS DOUBLE) AS rate FROM stock"""
    ),
)
register(
    "sec_outstanding_receivables",
    lambda m: parsed(E.bills(m.receivables, "-"), D.OUTSTANDING_RECEIVABLES).select(*BILL_COLUMNS),
    sql(f"{BILL_SQL} FROM receivables"),
)
register(
    "sec_outstanding_payables",
    lambda m: parsed(E.bills(m.payables, ""), D.OUTSTANDING_PAYABLES).select(*BILL_COLUMNS),
    sql(f"{BILL_SQL} FROM payables"),
)
register(
    "sec_profit_loss",
    lambda m: parsed(E.profit_loss(m), D.PROFIT_LOSS).select("company_id", "particulars", "amount", "is_debit", "raw_amount", "is_income", "level"),
    sql(
        """SELECT company_id, particulars, CAST(amount AS DOUBLE) AS amount, is_debit, CAST(raw_amount AS DOUBLE) AS raw_amount, is_income, level
        FROM profit_loss"""
    ),
)
register(
    "sec_balance_sheet",
    lambda m: parsed(E.balance_sheet(m), D.BALANCE_SHEET).select("company_id", "particulars", "amount", "side"),
    sql("SELECT company_id, particulars, CAST(amount AS DOUBLE) AS amount, side FROM balance_sheet"),
)
register(
    "sec_trial_balance",
    lambda m: parsed(E.trial_balance(m), D.TRIAL_BALANCE).select("company_id", "particulars", "debit", "credit"),
    sql("SELECT company_id, particulars, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit FROM trial_balance"),
)

# ---- definitions and projections on parsed rows ----------------------------------------------------------

ALL_TRANSFORMS = Section(
    "all_transforms",
    rows=("BODY/DATA/COLLECTION/STOCKITEM",),
    required="t_string",
    fields=fields(
        """
        t_string    string              @NAME
        t_int       int                 CLOSINGBALANCE
        t_float     float               CLOSINGVALUE
        t_abs       abs_float           CLOSINGVALUE
        t_date      date                BASEUNITS
        t_quantity  quantity_value_abs  CLOSINGBALANCE
        t_unit      quantity_unit       CLOSINGBALANCE
        t_yes       bool_yesno          BASEUNITS
        """
    ),
)
register(
    "def_transforms",
    # Adding 0 turns the -0.0 of an empty stock into 0.0, which prints alike everywhere.
    lambda m: parsed(E.stock_items(m), ALL_TRANSFORMS).drop("chunk", "pos").withColumn("t_float", F.col("t_float") + F.lit(0.0)),
    sql(
        """SELECT company_id, name AS t_string, CAST(signed_qty AS BIGINT) AS t_int, CAST(-closing_value AS DOUBLE) + 0.0 AS t_float,
        CAST(closing_value AS DOUBLE) AS t_abs, NULL AS t_date, CAST(closing_qty AS DOUBLE) AS t_quantity, 'Nos' AS t_unit, FALSE AS t_yes
        FROM stock"""
    ),
)
CHILDREN_JSON = """{"response": {"mode": "list", "row_path_options": ["ENVELOPE.BODY.DATA.COLLECTION.VOUCHER", "messages.VOUCHER"],
  "required_field": "guid", "fields": {"guid": {"sources": ["@REMOTEID"]}},
  "children": [{"name": "lines", "source_paths": ["NONE.LIST", "ALLLEDGERENTRIES.LIST", "LEDGERENTRIES.LIST"], "required_field": "ledger",
    "fields": {"ledger": {"sources": ["LEDGERNAME"]}},
    "children": [{"name": "bills", "source_paths": ["BILLALLOCATIONS.LIST"], "fields": {"bill": {"sources": ["NAME"]}}}]}]}}"""
register(
    "def_children",
    lambda m: parsed(E.vouchers(m), section_from_json("nested", CHILDREN_JSON))
    .select("guid", F.explode("lines").alias("l"))
    .select("guid", "l.ledger", F.array_join(F.transform("l.bills", lambda b: b["bill"]), ",").alias("bills")),
    sql("SELECT tally_guid AS guid, ledger_name AS ledger, coalesce(bill_name, '') AS bills FROM entries"),
)
FILTERED_JSON = """{"request": {"filters": ["Valid", "Regular"], "system_formulae": [
    {"name": "Valid", "expression": "NOT $IsCancelled"}, {"name": "Regular", "expression": "not $IsOptional"},
    {"name": "Unused", "expression": "$IsInvoice"}]},
  "response": {"mode": "list", "row_path_options": ["ENVELOPE.BODY.DATA.COLLECTION.VOUCHER", "messages.VOUCHER"],
  "required_field": "guid", "fields": {"guid": {"sources": ["@REMOTEID"]}, "number": {"sources": ["VOUCHERNUMBER"]}}}}"""
register(
    "def_filters",
    lambda m: parsed(E.vouchers(m), section_from_json("filtered", FILTERED_JSON)).select("company_id", "guid", "number"),
    sql("SELECT company_id, tally_guid AS guid, voucher_number AS number FROM vouchers WHERE NOT is_cancelled AND NOT is_optional"),
)


def asked_sections(m: Model) -> DataFrame:
    """A landed response per event, of a section named after the event unless it is a purchase or a signup."""
    kind = F.col("event_type")
    name = F.when(kind == "purchase", "vouchers").when(kind == "signup", "ledgers").otherwise(kind)
    return m.table("events").select("event_id", name.alias("section"))


register(
    "def_unknown_section",
    lambda m: D.unknown_sections(asked_sections(m)),
    "SELECT event_id, event_type AS section FROM events WHERE event_type NOT IN ('purchase', 'signup')",
)
PATHS = Section(
    "paths", rows=("BODY/DATA/COLLECTION/VOUCHER", "messages/VOUCHER"), required="guid",
    fields=fields("guid string @REMOTEID\nfirst_ledger string LEDGERENTRIES.LIST/LEDGERNAME\nfirst_bill string LEDGERENTRIES.LIST/BILLALLOCATIONS.LIST/NAME\nnone string LEDGERENTRIES.LIST/NONE/NAME"),
)
register(
    "proj_resolve_path",
    lambda m: parsed(E.vouchers(m), PATHS).select("guid", "first_ledger", "first_bill", "none"),
    sql("SELECT tally_guid AS guid, party_name AS first_ledger, voucher_number AS first_bill, '' AS none FROM vouchers"),
)
register(
    "proj_drop_nested",
    lambda m: split(m)[0].select(*VOUCHER_COLUMNS),
    sql(
        """SELECT company_id, tally_guid, voucher_number, voucher_type, CAST(date AS VARCHAR) AS date, party_name, narration, is_cancelled,
        reference, is_invoice, 'Listed' AS view FROM vouchers"""
    ),
)
