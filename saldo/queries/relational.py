"""Queries over the ledger tables: filters, joins, totals, ordered computations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.functions import scalars as S
from saldo.operators.skew import PAGE_ROWS
from saldo.operators import aggregates as A, collection as C, filters as P, joins as J, ordering as O, windows as W
from saldo.queries.model import AS_OF, Model, plain, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

COMPANY = "ASIA"
HEADER = "company_id, tally_guid, voucher_type, CAST(date AS VARCHAR) AS date, party_name, CAST(amount AS DOUBLE) AS amount"
HEADER_COLUMNS = ["company_id", "tally_guid", "voucher_type", "date", "party_name", "amount"]
BILL = """company_id, party_name, type, voucher_number, CAST(voucher_date AS VARCHAR) AS voucher_date,
  CAST(due_date AS VARCHAR) AS due_date, CAST(pending_amount AS DOUBLE) AS pending_amount,
  CAST(days_overdue AS BIGINT) AS days_overdue"""
BILL_COLUMNS = ["company_id", "party_name", "type", "voucher_number", "voucher_date", "due_date", "pending_amount", "days_overdue"]
STOCK = """company_id, name, group_name, unit, CAST(closing_qty AS DOUBLE) AS closing_qty,
  CAST(closing_value AS DOUBLE) AS closing_value, CAST(rate AS DOUBLE) AS rate"""
STOCK_COLUMNS = ["company_id", "name", "group_name", "unit", "closing_qty", "closing_value", "rate"]
SIGNED = "CASE WHEN voucher_type IN ('Sales', 'Receipt', 'Debit Note') THEN abs(amount) ELSE -abs(amount) END"
INR = """'₹' || CASE WHEN length(w) <= 3 THEN w ELSE
  regexp_replace(reverse(regexp_replace(reverse(substr(w, 1, length(w) - 3)), '(..)', '\\1,', 'g')), '^,', '') || ',' || right(w, 3) END"""


def whole(amount: str) -> str:
    return f"CAST(floor(abs({amount}) + 0.5) AS BIGINT)::VARCHAR"


def register(name: str, build, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, folder: plain(build(Model(spark, folder)))
    if oracle:
        ORACLE[name] = oracle


def company(m: Model) -> str:
    return J.company_id_of(m.companies, COMPANY)


COMPANY_SQL = f"company_id = (SELECT company_id FROM companies WHERE name = '{COMPANY}')"

# ---- projections and filters -----------------------------------------------------------------------------

register(
    "proj_fetch",
    lambda m: C.collection_query(m.ledgers, fetch=["company_id", "name", "group_name", "closing_balance", "master_id"]),
    sql("SELECT company_id, name, group_name, CAST(closing_balance AS DOUBLE) AS closing_balance, master_id FROM ledgers"),
)
register(
    "proj_first_non_empty",
    lambda m: m.vouchers.select("tally_guid", S.first_non_empty("reference", "voucher_number").alias("label")),
    sql("SELECT tally_guid, coalesce(nullif(trim(reference), ''), nullif(trim(voucher_number), '')) AS label FROM vouchers"),
)
register(
    "proj_default",
    lambda m: m.vouchers.select("tally_guid", S.default_if_empty("reference", "none").alias("reference")),
    sql("SELECT tally_guid, coalesce(nullif(trim(reference), ''), 'none') AS reference FROM vouchers"),
)
register(
    "flt_required",
    lambda m: P.required(m.vouchers, "reference").select(*HEADER_COLUMNS, "reference"),
    sql(f"SELECT {HEADER}, reference FROM vouchers WHERE trim(reference) <> ''"),
)
register(
    "flt_valid_guid",
    lambda m: P.valid_guid(
        m.vouchers.withColumn("tally_guid", F.when(~F.col("is_optional"), F.col("tally_guid")))
    ).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE NOT is_optional"),
)
register(
    "flt_child_named",
    lambda m: P.named_items(
        m.items.withColumn("stock_item_name", F.when(F.col("discount_pct") > 0, F.col("stock_item_name")).otherwise(" "))
    ).select("tally_guid", "stock_item_name", "amount"),
    sql("SELECT tally_guid, stock_item_name, CAST(amount AS DOUBLE) AS amount FROM items WHERE discount_pct > 0"),
)
register(
    "flt_not_cancelled",
    lambda m: P.not_cancelled(m.vouchers).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE NOT is_cancelled"),
)
register(
    "flt_not_optional",
    lambda m: P.not_optional(m.vouchers).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE NOT is_optional"),
)
register(
    "flt_non_aggregate_company",
    lambda m: P.non_aggregate(
        m.customers.select(
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "Yes").otherwise("No").alias("is_aggregate"),
        )
    ),
    sql("SELECT c_name AS name, 'No' AS is_aggregate FROM customers WHERE c_mktsegment <> 'MACHINERY'"),
)
register(
    "flt_date_window",
    lambda m: P.date_window(m.vouchers, "19970401", "19980331").select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE date BETWEEN DATE '1997-04-01' AND DATE '1998-03-31'"),
)
register(
    "flt_company",
    lambda m: P.of_company(m.vouchers, company(m)).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE {COMPANY_SQL}"),
)
register(
    "flt_party",
    lambda m: P.of_party(m.vouchers, "Customer#000000007").select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE party_name = 'Customer#000000007'"),
)
register(
    "flt_in_list",
    lambda m: P.parties(m.ledgers.unionByName(m.cash_ledgers, allowMissingColumns=True)).select("company_id", "name", "group_name"),
    sql("SELECT company_id, name, group_name FROM ledgers"),
)
register(
    "flt_voucher_type",
    lambda m: P.of_voucher_type(m.vouchers, "Purchase").select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE voucher_type = 'Purchase'"),
)
register(
    "flt_outstanding_type",
    lambda m: P.of_outstanding_type(m.outstanding, "payable").select(*BILL_COLUMNS),
    sql(f"SELECT {BILL} FROM outstanding WHERE type = 'payable'"),
)
register(
    "flt_party_type",
    lambda m: P.of_party_type(m.ledgers.withColumn("type", S.party_type("group_name")), "supplier").select("company_id", "name", "type"),
    sql("SELECT company_id, name, 'supplier' AS type FROM ledgers WHERE group_name <> 'Sundry Debtors'"),
)
register(
    "flt_enabled_companies",
    lambda m: P.enabled_companies(m.vouchers, m.companies.withColumn("enabled", F.col("name").startswith("A"))).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers WHERE company_id IN (SELECT company_id FROM companies WHERE name LIKE 'A%')"),
)

# ---- joins -----------------------------------------------------------------------------------------------

def nested_sql(page_rows: int = PAGE_ROWS) -> str:
    return f"""SELECT v.company_id, v.tally_guid, CAST(v.date AS VARCHAR) AS date, coalesce(i.item_page, 0) AS item_page,
  coalesce(i.n, 0) AS item_count, coalesce(i.listing, '') AS items
FROM vouchers v LEFT JOIN (
  SELECT company_id, tally_guid, line // {page_rows} AS item_page, count(*) AS n,
    string_agg(stock_item_name || '|' || CAST(quantity AS BIGINT) || '|' || CAST(amount AS VARCHAR), ';'
      ORDER BY stock_item_name, quantity, rate, discount_pct, amount) AS listing
  FROM items GROUP BY company_id, tally_guid, line // {page_rows}) i USING (company_id, tally_guid)"""


NESTED_SQL = nested_sql()


def listing(items: str = "items"):
    """Nested items as one text that both engines can build."""
    return F.array_join(
        F.transform(
            items,
            lambda i: F.concat_ws("|", i["stock_item_name"], i["quantity"].cast("bigint").cast("string"), i["amount"].cast("string")),
        ),
        ";",
    )


def nested(m: Model, page_rows: int = PAGE_ROWS):
    return J.vouchers_with_items(m.vouchers, m.items, page_rows)


def listed(m: Model, page_rows: int = PAGE_ROWS):
    return nested(m, page_rows).select(
        "company_id", "tally_guid", "date", "item_page", F.size("items").alias("item_count"), listing().alias("items")
    )


register(
    "join_company_by_name",
    lambda m: J.company_by_name(
        m.customers.select(F.col("c_name").alias("party_name"), F.col("r_name").alias("company_name")), m.companies
    ),
    sql("SELECT c_name AS party_name, r_name AS company_name, company_id FROM customers"),
)
register(
    "join_voucher_id_map",
    lambda m: J.voucher_ids(m.items, m.vouchers.withColumn("id", F.sha2(F.concat_ws("|", "company_id", "tally_guid"), 256))).select(
        "voucher_id", "stock_item_name", "amount"
    ),
    sql("SELECT sha256(company_id || '|' || tally_guid) AS voucher_id, stock_item_name, CAST(amount AS DOUBLE) AS amount FROM items"),
)
register("join_voucher_items_nested", listed, sql(NESTED_SQL))
register("join_voucher_items_paged", lambda m: listed(m, 3), sql(nested_sql(3)))
register(
    "join_party_outstanding",
    lambda m: J.parties_with_outstanding(m.ledgers, m.outstanding).select("company_id", "name", "total_outstanding"),
    sql(
        """SELECT l.company_id, l.name, CAST(coalesce(o.t, 0) AS DOUBLE) AS total_outstanding FROM ledgers l
        LEFT JOIN (SELECT company_id, party_name, sum(abs(pending_amount)) AS t FROM outstanding GROUP BY 1, 2) o
        ON o.company_id = l.company_id AND o.party_name = l.name"""
    ),
)


def profile(m: Model):
    found = J.party_profile(m.ledgers, m.outstanding, m.vouchers)
    key = ["company_id", "party_name"]
    bills = found.bills.groupBy(*key).agg(F.count(F.lit(1)).alias("bills"))
    entries = found.vouchers.groupBy(*key).agg(F.count(F.lit(1)).alias("entries"))
    zero = F.lit(0).cast("bigint")
    return (
        found.ledgers.select(*key, "group_name", "closing_balance")
        .join(bills, key, "left")
        .join(entries, key, "left")
        .withColumn("bills", F.coalesce("bills", zero))
        .withColumn("entries", F.coalesce("entries", zero))
    )


register(
    "join_party_profile",
    profile,
    sql(
        """SELECT l.company_id, l.name AS party_name, l.group_name, CAST(l.closing_balance AS DOUBLE) AS closing_balance,
          coalesce(b.n, 0) AS bills, coalesce(v.n, 0) AS entries FROM ledgers l
        LEFT JOIN (SELECT company_id, party_name, count(*) AS n FROM outstanding GROUP BY 1, 2) b
          ON b.company_id = l.company_id AND b.party_name = l.name
        LEFT JOIN (SELECT company_id, party_name, count(*) AS n FROM vouchers GROUP BY 1, 2) v
          ON v.company_id = l.company_id AND v.party_name = l.name"""
    ),
)


def merged_counts(m: Model):
    per_type = m.vouchers.groupBy("company_id", F.col("voucher_type").alias("section"))
    old = per_type.agg(F.count(F.lit(1)).alias("n")).filter(F.col("section") != "Payment")
    new = per_type.agg(F.count(F.when(F.col("is_cancelled"), 1)).alias("n")).filter(F.col("section") != "Sales")
    return J.merge_counts(old, new, ["company_id", "section"])


register(
    "join_merge_counts",
    merged_counts,
    sql(
        """SELECT company_id, voucher_type AS section,
          CASE WHEN voucher_type = 'Sales' THEN count(*) ELSE count(CASE WHEN is_cancelled THEN 1 END) END AS n
        FROM vouchers GROUP BY 1, 2"""
    ),
)
register(
    "anti_replace",
    lambda m: J.keep_unreplaced(m.items, P.not_cancelled(m.vouchers), J.VOUCHER).select("tally_guid", "stock_item_name", "amount"),
    sql(
        """SELECT i.tally_guid, i.stock_item_name, CAST(i.amount AS DOUBLE) AS amount FROM items i
        JOIN vouchers v USING (company_id, tally_guid) WHERE v.is_cancelled"""
    ),
)

# ---- aggregates ------------------------------------------------------------------------------------------

register(
    "agg_outstanding_by_party",
    lambda m: A.outstanding_by_party(m.outstanding),
    sql("SELECT company_id, party_name, CAST(sum(abs(pending_amount)) AS DOUBLE) AS total_outstanding FROM outstanding GROUP BY 1, 2"),
)
register(
    "agg_party_outstanding_total",
    lambda m: A.party_outstanding_total(P.of_party(m.outstanding, "Supplier#000000003")),
    sql("SELECT CAST(coalesce(sum(abs(pending_amount)), 0) AS DOUBLE) AS total_outstanding FROM outstanding WHERE party_name = 'Supplier#000000003'"),
)
register(
    "agg_record_counts",
    lambda m: A.record_counts(
        {"ledgers": m.ledgers, "vouchers": m.vouchers, "groups": None, "outstanding": m.outstanding}, ["company_id"]
    ).select("company_id", F.explode("records").alias("section", "n")),
    sql(
        """SELECT company_id, 'ledgers' AS section, count(*) AS n FROM ledgers GROUP BY 1
        UNION ALL SELECT company_id, 'vouchers', count(*) FROM vouchers GROUP BY 1
        UNION ALL SELECT company_id, 'outstanding', count(*) FROM outstanding GROUP BY 1"""
    ),
)
register(
    "agg_day_total",
    lambda m: A.day_total(m.vouchers, "Sales", "2000-03-01"),
    sql("SELECT CAST(coalesce(sum(abs(amount)), 0) AS DOUBLE) AS total FROM vouchers WHERE voucher_type = 'Sales' AND date = DATE '2000-03-01'"),
)
register(
    "agg_outstanding_total",
    lambda m: A.outstanding_total(m.outstanding),
    sql(
        """SELECT CAST(sum(CASE WHEN type = 'receivable' THEN pending_amount ELSE 0 END) AS DOUBLE) AS total_receivable,
          CAST(sum(CASE WHEN type = 'payable' THEN pending_amount ELSE 0 END) AS DOUBLE) AS total_payable FROM outstanding"""
    ),
)
register(
    "agg_stock_value",
    lambda m: A.stock_value(m.stock, ["company_id"]),
    sql("SELECT company_id, CAST(sum(abs(closing_value)) AS DOUBLE) AS stock_value, count(*) AS item_count FROM stock GROUP BY 1"),
)
KPI_SQL = f"""SELECT c.company_id,
  CAST(coalesce((SELECT sum(amount) FROM vouchers v WHERE v.company_id = c.company_id AND voucher_type = 'Sales' AND date = DATE '2000-03-01'), 0) AS DOUBLE) AS today_sales,
  CAST(coalesce((SELECT sum(amount) FROM vouchers v WHERE v.company_id = c.company_id AND voucher_type = 'Purchase' AND date = DATE '2000-03-01'), 0) AS DOUBLE) AS today_purchases,
  CAST(coalesce((SELECT sum(pending_amount) FROM outstanding o WHERE o.company_id = c.company_id AND type = 'receivable'), 0) AS DOUBLE) AS total_receivable,
  CAST(coalesce((SELECT sum(pending_amount) FROM outstanding o WHERE o.company_id = c.company_id AND type = 'payable'), 0) AS DOUBLE) AS total_payable,
  CAST(coalesce((SELECT sum(closing_value) FROM stock s WHERE s.company_id = c.company_id), 0) AS DOUBLE) AS stock_value
FROM companies c"""
register("agg_dashboard_kpis", lambda m: A.dashboard_kpis(m.vouchers, m.outstanding, m.stock, "2000-03-01"), sql(KPI_SQL))
register(
    "agg_voucher_filter_total",
    lambda m: A.voucher_type_totals(m.vouchers),
    sql(
        """SELECT coalesce(voucher_type, 'All') AS voucher_type, count(*) AS entries, CAST(sum(abs(amount)) AS DOUBLE) AS total
        FROM vouchers GROUP BY GROUPING SETS ((voucher_type), ())"""
    ),
)
register(
    "agg_items_per_voucher",
    lambda m: A.items_per_voucher(m.items),
    sql("SELECT company_id, tally_guid, count(*) AS item_count FROM items GROUP BY 1, 2"),
)
register(
    "agg_party_counts",
    lambda m: A.party_counts(P.parties(m.ledgers), ["company_id"]),
    sql("SELECT company_id, CASE WHEN group_name = 'Sundry Debtors' THEN 'customer' ELSE 'supplier' END AS type, count(*) AS parties FROM ledgers GROUP BY 1, 2"),
)
PNL_SQL = """SELECT company_id, CAST(income AS DOUBLE) AS income, CAST(expenses AS DOUBLE) AS expenses,
  CAST(income - expenses AS DOUBLE) AS profit, CASE WHEN income >= expenses THEN 'Net Profit' ELSE 'Net Loss' END AS label
FROM (SELECT company_id, sum(CASE WHEN is_income THEN amount ELSE 0 END) AS income,
    sum(CASE WHEN is_income THEN 0 ELSE amount END) AS expenses FROM profit_loss WHERE level = 'main' GROUP BY 1)"""
register("agg_pnl_totals", lambda m: A.pnl_totals(m.profit_loss, ["company_id"]), sql(PNL_SQL))
BALANCE_SQL = """SELECT company_id, CAST(sum(CASE WHEN side = 'asset' THEN amount ELSE 0 END) AS DOUBLE) AS total_assets,
  CAST(sum(CASE WHEN side = 'liability' THEN amount ELSE 0 END) AS DOUBLE) AS total_liabilities FROM balance_sheet GROUP BY 1"""
register("agg_balance_totals", lambda m: A.balance_totals(m.balance_sheet, ["company_id"]), sql(BALANCE_SQL))
register(
    "agg_any_metric",
    lambda m: A.any_metric(
        m.stock.withColumn("rate", F.when(F.col("group_name") > "Brand#2", F.col("rate"))).withColumn(
            "closing_value", F.when(F.col("group_name") > "Brand#2", F.col("closing_value"))
        ),
        ["company_id", "group_name"],
    ),
    sql("SELECT company_id, group_name, bool_or(group_name > 'Brand#2' AND (closing_value <> 0 OR rate <> 0)) AS has_metrics FROM stock GROUP BY 1, 2"),
)

# ---- ordered computations --------------------------------------------------------------------------------

RUNNING_SQL = f"""SELECT company_id, party_name, tally_guid, CAST(sum({SIGNED}) OVER (PARTITION BY company_id, party_name
  ORDER BY date ASC NULLS LAST, tally_guid ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance FROM vouchers"""
register(
    "win_running_balance",
    lambda m: W.running_balance(m.vouchers).select("company_id", "party_name", "tally_guid", "running_balance"),
    sql(RUNNING_SQL),
)
register(
    "win_latest_per_key",
    lambda m: W.latest_per_key(m.table("events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select(
        "user_id", "event_id", "event_type", "value"
    ),
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
register(
    "sort_vouchers_date_desc",
    lambda m: O.newest_first(m.vouchers).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers v ORDER BY v.date DESC NULLS FIRST, tally_guid"),
)
register(
    "sort_party_date_asc",
    lambda m: O.oldest_first(P.of_company(m.vouchers, company(m))).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers v WHERE {COMPANY_SQL} ORDER BY v.date ASC NULLS LAST, tally_guid"),
)
register(
    "sort_overdue_desc",
    lambda m: O.most_overdue_first(m.outstanding).select(*BILL_COLUMNS),
    sql(f"SELECT {BILL} FROM outstanding o ORDER BY o.days_overdue DESC NULLS FIRST, type, voucher_number, party_name"),
)
register(
    "topk_recent",
    lambda m: O.recent(m.vouchers).select(*HEADER_COLUMNS),
    sql(f"SELECT {HEADER} FROM vouchers v ORDER BY v.date DESC NULLS LAST, tally_guid LIMIT 10"),
)
register(
    "topk_log_tail",
    lambda m: O.log_tail(
        m.table("events").select("event_id", F.concat(F.lit(" "), "event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("line")),
        "event_id",
    ),
    """SELECT event_id, event_type || ' by ' || user_id AS line, contains(event_type, 'error') AS is_error
    FROM events ORDER BY event_id DESC LIMIT 501""",
)

# ---- scalar functions on whole columns -------------------------------------------------------------------


def amount_text(m: Model):
    """Amounts as exports write them: grouped digits, a unit after a blank or a slash, or no number."""
    grouped = F.format_number("l_extendedprice", 2)
    flag = F.col("l_returnflag")
    return m.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        F.when(flag == "A", F.concat(grouped, F.lit("/Nos")))
        .when(flag == "R", F.concat(F.lit(" -"), grouped, F.lit(" Dr")))
        .otherwise("n/a").alias("t"),
    )


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
register(
    "fn_safe_float",
    lambda m: amount_text(m).select(*LINE_KEY, S.safe_float("t").alias("v")),
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN l_extendedprice
      WHEN 'R' THEN -l_extendedprice ELSE 0.0 END AS v FROM lineitem""",
)
register(
    "fn_abs_float",
    lambda m: amount_text(m).select(*LINE_KEY, S.abs_float("t").alias("v")),
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag IN ('A', 'R') THEN l_extendedprice ELSE 0.0 END AS v FROM lineitem""",
)
register(
    "fn_safe_int",
    lambda m: m.table("orders").select(
        "o_orderkey",
        S.safe_int(
            F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" Days")))
            .when(F.col("o_orderstatus") == "O", F.format_number("o_totalprice", 2))
        ).alias("v"),
    ),
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END AS v FROM orders",
)
register(
    "fn_safe_str",
    lambda m: m.vouchers.select("tally_guid", S.safe_str(F.when(~F.col("is_invoice"), F.concat(F.lit(" \t"), "reference", F.lit("\n ")))).alias("v")),
    sql("SELECT tally_guid, CASE WHEN is_invoice THEN '' ELSE reference END AS v FROM vouchers"),
)
register(
    "fn_stringify",
    lambda m: m.vouchers.select("tally_guid", S.join_parts(F.array("voucher_type", "reference", F.lit(None), "party_name")).alias("v")),
    sql("SELECT tally_guid, voucher_type || CASE WHEN reference = '' THEN '' ELSE ', ' || reference END || ', ' || party_name AS v FROM vouchers"),
)
DATE_FORMS = ("yyyyMMdd", "d-MMM-yy", "d-MMM-yyyy", "dd-MM-yyyy")
register(
    "fn_parse_date",
    lambda m: m.vouchers.select(
        "tally_guid",
        S.parse_date(
            F.when(F.col("voucher_type") == "Sales", F.date_format("date", DATE_FORMS[0]))
            .when(F.col("voucher_type") == "Purchase", F.upper(F.date_format("date", DATE_FORMS[1])))
            .when(F.col("voucher_type") == "Receipt", F.date_format("date", DATE_FORMS[2]))
            .when(F.col("voucher_type") == "Payment", F.date_format("date", DATE_FORMS[3]))
            .otherwise(F.date_format("date", "yyyy/MM/dd"))
        ).alias("v"),
    ),
    sql("SELECT tally_guid, CASE WHEN voucher_type <> 'Debit Note' THEN CAST(date AS VARCHAR) END AS v FROM vouchers"),
)


def quantity_text():
    qty = F.col("l_quantity").cast("bigint").cast("string")
    flag = F.col("l_returnflag")
    return F.when(flag == "A", F.concat(F.lit("-"), qty, F.lit(" Nos"))).when(flag == "R", qty).otherwise("BOX")


register(
    "fn_quantity_value",
    lambda m: m.table("lineitem").select(*LINE_KEY, S.quantity_value(quantity_text()).alias("v")),
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity ELSE 0.0 END AS v FROM lineitem",
)
register(
    "fn_quantity_unit",
    lambda m: m.table("lineitem").select(*LINE_KEY, S.quantity_unit(quantity_text()).alias("v")),
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'Nos' WHEN 'R' THEN '' ELSE 'BOX' END AS v FROM lineitem",
)
register(
    "fn_bool_yesno",
    lambda m: m.table("orders").select(
        "o_orderkey",
        S.bool_yesno(F.when(F.col("o_orderstatus") == "F", " YES").when(F.col("o_orderstatus") == "O", "No")).alias("v"),
    ),
    "SELECT o_orderkey, o_orderstatus = 'F' AS v FROM orders",
)
register(
    "fn_iso_to_compact",
    lambda m: m.vouchers.select("tally_guid", S.iso_to_compact(F.col("date").cast("string")).alias("v")),
    sql("SELECT tally_guid, strftime(date, '%Y%m%d') AS v FROM vouchers"),
)
register(
    "fn_compact_to_date",
    lambda m: m.vouchers.select("tally_guid", S.compact_to_date(F.date_format("date", "yyyyMMdd")).alias("v")),
    sql("SELECT tally_guid, CAST(date AS VARCHAR) AS v FROM vouchers"),
)
register(
    "fn_iso_to_date",
    lambda m: m.vouchers.select(
        "tally_guid", S.iso_to_date(F.when(F.col("is_invoice"), F.col("date").cast("string")).otherwise("2000-02-30")).alias("v")
    ),
    sql("SELECT tally_guid, CASE WHEN is_invoice THEN CAST(date AS VARCHAR) END AS v FROM vouchers"),
)
register(
    "fn_fiscal_year_bounds",
    lambda m: m.vouchers.select("tally_guid", S.fiscal_year_start("date").alias("fy_from"), F.col("date").alias("fy_to")),
    sql(
        """SELECT tally_guid, CAST(make_date(CAST(year(date) - CASE WHEN month(date) < 4 THEN 1 ELSE 0 END AS INTEGER), 4, 1) AS VARCHAR) AS fy_from,
          CAST(date AS VARCHAR) AS fy_to FROM vouchers"""
    ),
)
register(
    "fn_render_template",
    lambda m: m.vouchers.select(
        "tally_guid",
        S.render_template("{{ kind }} of {{party}}{{ unknown }} on {{ day }}", {"kind": "voucher_type", "party": "party_name", "day": "date"}).alias("v"),
    ),
    sql("SELECT tally_guid, voucher_type || ' of ' || party_name || ' on ' || date AS v FROM vouchers"),
)
register(
    "fn_party_type",
    lambda m: m.ledgers.select("company_id", "name", S.party_type("group_name").alias("type")),
    sql("SELECT company_id, name, CASE WHEN group_name = 'Sundry Debtors' THEN 'customer' ELSE 'supplier' END AS type FROM ledgers"),
)
register(
    "fn_signed_amount",
    lambda m: m.vouchers.select("tally_guid", S.signed_amount("voucher_type", "amount").alias("v")),
    sql(f"SELECT tally_guid, CAST({SIGNED} AS DOUBLE) AS v FROM vouchers"),
)
BUCKET = "CASE WHEN days_overdue > 90 THEN 'over 90' WHEN days_overdue > 60 THEN '61-90' WHEN days_overdue > 30 THEN '31-60' ELSE 'current' END"
register(
    "fn_aging_bucket",
    lambda m: m.outstanding.select("voucher_number", "days_overdue", S.aging_bucket("days_overdue").alias("bucket")),
    sql(f"SELECT voucher_number, CAST(days_overdue AS BIGINT) AS days_overdue, {BUCKET} AS bucket FROM outstanding"),
)
register(
    "fn_stock_status",
    lambda m: m.stock.select("name", S.stock_status("closing_qty").alias("status"), (F.col("signed_qty") < 0).alias("is_negative")),
    sql("SELECT name, CASE WHEN closing_qty > 0 THEN 'In stock' ELSE 'Out of stock' END AS status, signed_qty < 0 AS is_negative FROM stock"),
)
register(
    "fn_format_inr",
    lambda m: m.outstanding.select("voucher_number", S.format_inr(-F.col("pending_amount")).alias("v")),
    sql(f"SELECT voucher_number, {INR} AS v FROM (SELECT voucher_number, {whole('pending_amount')} AS w FROM outstanding)"),
)
register(
    "fn_dash_if_empty",
    lambda m: m.vouchers.select("tally_guid", S.dash_if_empty("reference").alias("v")),
    sql("SELECT tally_guid, coalesce(nullif(reference, ''), '—') AS v FROM vouchers"),
)
register(
    "fn_pnl_label",
    lambda m: m.profit_loss.select("company_id", "particulars", S.pnl_label("raw_amount").alias("v")),
    sql("SELECT company_id, particulars, CASE WHEN raw_amount >= 0 THEN 'Net Profit' ELSE 'Net Loss' END AS v FROM profit_loss"),
)

# ---- collection queries ----------------------------------------------------------------------------------

register(
    "op_collection_query",
    lambda m: C.collection_query(
        nested(m),
        fetch=["tally_guid", "party_name"],
        walk=["items"],
        compute={"item": "items.stock_item_name", "value": "items.quantity * items.rate"},
        filters=["NOT is_cancelled", "value > 50000"],
    ),
    sql(
        """SELECT tally_guid, party_name, stock_item_name AS item, CAST(quantity * rate AS DOUBLE) AS value
        FROM items JOIN vouchers USING (company_id, tally_guid) WHERE NOT is_cancelled AND quantity * rate > 50000"""
    ),
)
PERIODS = (("1995-01-01", "1995-12-31"), ("1997-04-01", "1998-03-31"), ("1998-01-01", "2001-08-01"))
PERIOD_SQL = ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in PERIODS)
register(
    "op_period_statistics",
    lambda m: C.period_statistics(m.vouchers, PERIODS),
    sql(
        f"""SELECT CAST(from_date AS VARCHAR) AS from_date, CAST(to_date AS VARCHAR) AS to_date, voucher_type, count(*) AS records
        FROM vouchers JOIN (VALUES {PERIOD_SQL}) p(from_date, to_date) ON date BETWEEN from_date AND to_date GROUP BY ALL"""
    ),
)
