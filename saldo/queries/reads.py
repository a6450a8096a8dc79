"""Queries for the served reads and the further reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.functions import scalars as S
from saldo.operators import joins as J
from saldo.plans import reads as R, reports as X
from saldo.queries.model import Model, plain, sql
from saldo.queries.relational import (
    BALANCE_SQL,
    BILL,
    BILL_COLUMNS,
    BUCKET,
    COMPANY_SQL,
    HEADER,
    HEADER_COLUMNS,
    INR,
    KPI_SQL,
    NESTED_SQL,
    PNL_SQL,
    SIGNED,
    STOCK,
    STOCK_COLUMNS,
    company,
    listing,
    whole,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, build, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, folder: plain(build(Model(spark, folder)))
    if oracle:
        ORACLE[name] = oracle


def account(m: Model):
    """Every party's transactions with the party's totals beside them."""
    found = R.party_ledger(m.ledgers, m.outstanding, m.vouchers, m.items)
    key = ["company_id", "party_name"]
    profile = found.profile.select(*key, "closing_balance", "total_outstanding", "total_transactions")
    return (
        found.transactions.withColumn("item_count", F.size("items"))
        .withColumn("items", listing())
        .join(profile, key, "left")
        .select(
            *key, "tally_guid", "date", "voucher_type", "voucher_number", "amount", "narration", "item_page", "item_count",
            "items", "running_balance", "closing_balance", "total_outstanding", "total_transactions",
        )
    )


ACCOUNT_SQL = f"""SELECT v.company_id, v.party_name, v.tally_guid, CAST(v.date AS VARCHAR) AS date, v.voucher_type, v.voucher_number,
  CAST(v.amount AS DOUBLE) AS amount, v.narration, n.item_page, n.item_count, n.items,
  CAST(sum({SIGNED}) OVER (PARTITION BY v.company_id, v.party_name ORDER BY v.date ASC NULLS LAST, v.tally_guid
    ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance,
  CAST(l.closing_balance AS DOUBLE) AS closing_balance, CAST(coalesce(o.t, 0) AS DOUBLE) AS total_outstanding,
  count(*) OVER (PARTITION BY v.company_id, v.party_name) AS total_transactions
FROM vouchers v JOIN nested n USING (company_id, tally_guid)
LEFT JOIN ledgers l ON l.company_id = v.company_id AND l.name = v.party_name
LEFT JOIN (SELECT company_id, party_name, sum(pending_amount) AS t FROM outstanding GROUP BY 1, 2) o
  ON o.company_id = v.company_id AND o.party_name = v.party_name"""
register("q_party_ledger", account, sql(ACCOUNT_SQL, f" nested AS ({NESTED_SQL})"))

PARTIES_SQL = """SELECT l.company_id, l.name, l.group_name AS "group",
  CASE WHEN l.group_name = 'Sundry Debtors' THEN 'customer' ELSE 'supplier' END AS type,
  CAST(l.closing_balance AS DOUBLE) AS closing_balance, CAST(coalesce(o.t, 0) AS DOUBLE) AS total_outstanding
FROM ledgers l LEFT JOIN (SELECT company_id, party_name, sum(abs(pending_amount)) AS t FROM outstanding GROUP BY 1, 2) o
  ON o.company_id = l.company_id AND o.party_name = l.name"""
register("q_parties", lambda m: R.parties(m.ledgers, m.outstanding), sql(PARTIES_SQL))
register(
    "q_vouchers",
    lambda m: R.vouchers(m.vouchers, m.items).select(
        *HEADER_COLUMNS, "item_page", F.size("items").alias("item_count"), listing().alias("items")
    ),
    sql(
        """SELECT v.company_id, v.tally_guid, v.voucher_type, CAST(v.date AS VARCHAR) AS date, v.party_name,
        CAST(v.amount AS DOUBLE) AS amount, n.item_page, n.item_count, n.items
        FROM vouchers v JOIN nested n USING (company_id, tally_guid) ORDER BY v.date DESC NULLS FIRST, v.tally_guid""",
        f" nested AS ({NESTED_SQL})",
    ),
)
register("q_outstanding", lambda m: R.outstanding(m.outstanding).select(*BILL_COLUMNS), sql(f"SELECT {BILL} FROM outstanding"))
register(
    "q_stock",
    lambda m: m.stock.filter(F.col("company_id") == company(m)).select(*STOCK_COLUMNS),
    sql(f"SELECT {STOCK} FROM stock WHERE {COMPANY_SQL}"),
)
PNL_COLUMNS = ["company_id", "particulars", "amount", "is_debit", "is_income", "level"]
register(
    "q_pnl",
    lambda m: m.profit_loss.filter(F.col("company_id") == company(m)).select(*PNL_COLUMNS),
    sql(f"SELECT company_id, particulars, CAST(amount AS DOUBLE) AS amount, is_debit, is_income, level FROM profit_loss WHERE {COMPANY_SQL}"),
)
register(
    "q_balance_sheet",
    lambda m: m.balance_sheet.filter(F.col("company_id") == company(m)).select("company_id", "particulars", "amount", "side"),
    sql(f"SELECT company_id, particulars, CAST(amount AS DOUBLE) AS amount, side FROM balance_sheet WHERE {COMPANY_SQL}"),
)
register(
    "q_trial_balance",
    lambda m: R.trial_balance(m.trial_balance).totals,
    sql(
        """SELECT company_id, CAST(sum(debit) AS DOUBLE) AS debit_total, CAST(sum(credit) AS DOUBLE) AS credit_total,
        sum(debit) = sum(credit) AS balanced FROM trial_balance GROUP BY 1"""
    ),
)
register(
    "q_alter_ids",
    lambda m: R.alter_ids(m.markers(cached=False), "7"),
    sql("SELECT alter_id, alt_vch_id, alt_mst_id FROM current_markers WHERE company_id = '7'"),
)


def dashboard(m: Model):
    """The KPI rows and the recent vouchers, stacked into one result."""
    found = R.dashboard(m.vouchers, m.outstanding, m.stock, "2000-03-01")
    kpis = found.kpis.select(
        "company_id",
        F.expr("stack(5, " + ", ".join(f"'{k}', {k}" for k in ("today_sales", "today_purchases", "total_receivable", "total_payable", "stock_value")) + ") AS (entry, value)"),
    )
    newest = found.recent.select(
        "company_id", F.concat(F.lit("recent "), "tally_guid").alias("entry"), F.col("amount").cast("decimal(28,2)").alias("value")
    )
    return kpis.unionByName(newest)


register(
    "q_dashboard",
    dashboard,
    sql(
        """SELECT company_id, entry, value FROM kpis UNPIVOT (value FOR entry IN (today_sales, today_purchases, total_receivable, total_payable, stock_value))
        UNION ALL SELECT company_id, 'recent ' || tally_guid, CAST(amount AS DOUBLE)
        FROM (SELECT * FROM vouchers ORDER BY date DESC NULLS LAST, tally_guid LIMIT 10)""",
        f" kpis AS ({KPI_SQL})",
    ),
)
register(
    "q_sales_view",
    lambda m: R.sales_view(m.vouchers, m.items, "Sales").rows.select(
        "tally_guid", "voucher_number", "party_name", "item_count", "shown_amount"
    ),
    sql(
        f"""SELECT tally_guid, voucher_number, party_name, item_count, {INR} AS shown_amount
        FROM (SELECT v.tally_guid, voucher_number, party_name, coalesce(n, 0) AS item_count, {whole('amount')} AS w FROM vouchers v
          LEFT JOIN (SELECT company_id, tally_guid, count(*) AS n FROM items GROUP BY 1, 2) i USING (company_id, tally_guid)
          WHERE voucher_type = 'Sales')"""
    ),
)
for name, tab in (("q_outstanding_view", "receivable"), ("q_outstanding_payable_view", "payable")):
    register(
        name,
        lambda m, tab=tab: R.outstanding_view(m.outstanding, tab).rows.select(
            "party_name", "voucher_number", "due_date", "days_overdue", "bucket", "shown_amount"
        ),
        sql(
            f"""SELECT party_name, voucher_number, CAST(due_date AS VARCHAR) AS due_date, CAST(days_overdue AS BIGINT) AS days_overdue,
            {BUCKET} AS bucket, {INR} AS shown_amount
            FROM (SELECT *, {whole('pending_amount')} AS w FROM outstanding WHERE type = '{tab}')"""
        ),
    )
register(
    "q_inventory_view",
    lambda m: R.inventory_view(m.stock).rows.select("name", "unit", "status", "shown_rate", "shown_value"),
    sql(
        f"""SELECT name, unit, status, CASE WHEN rate <> 0 THEN shown_rate ELSE '—' END AS shown_rate, {INR} AS shown_value
        FROM (SELECT *, {INR} AS shown_rate, {whole('closing_value')} AS w2 FROM (
          SELECT *, {whole('rate')} AS w, CASE WHEN closing_qty > 0 THEN 'In stock' ELSE 'Out of stock' END AS status FROM stock))""".replace(
            f"{INR} AS shown_value", INR.replace("(w", "(w2").replace(" w ", " w2 ") + " AS shown_value"
        )
    ),
)
for name, tab in (("q_parties_view", "customer"), ("q_parties_supplier_view", "supplier")):
    register(
        name,
        lambda m, tab=tab: R.parties_view(m.ledgers, m.outstanding, tab).rows.select("company_id", "name", "shown_outstanding"),
        sql(
            f"""SELECT company_id, name, CASE WHEN total_outstanding > 0 THEN {INR} ELSE '—' END AS shown_outstanding
            FROM (SELECT *, {whole('total_outstanding')} AS w FROM party_rows WHERE type = '{tab}')""",
            " party_rows AS (" + PARTIES_SQL.replace("CAST(coalesce(o.t, 0) AS DOUBLE)", "coalesce(o.t, 0)") + ")",
        ),
    )

SALES_TABS = ("All", "Sales", "Purchase", "Receipt", "Payment")


def view_totals(m: Model):
    """What the list views show above their rows, for every tab."""
    found = {("sales", tab): R.sales_view(m.vouchers, m.items, tab).totals for tab in SALES_TABS}
    found |= {("outstanding", tab): R.outstanding_view(m.outstanding, tab).totals for tab in ("receivable", "payable")}
    found[("inventory", "All")] = R.inventory_view(m.stock).totals.select(
        F.col("item_count").alias("entries"), F.col("stock_value").alias("total")
    )
    found |= {
        ("parties", tab): R.parties_view(m.ledgers, m.outstanding, tab).totals.withColumnRenamed("parties", "entries")
        for tab in ("customer", "supplier")
    }
    out = None
    for (view, tab), totals in found.items():
        for name, kind in (("entries", "long"), ("total", "decimal(28,2)")):
            if name not in totals.columns:
                totals = totals.withColumn(name, F.lit(None).cast(kind))
        rows = totals.select(F.lit(view).alias("view"), F.lit(tab).alias("tab"), "entries", F.col("total").cast("decimal(28,2)"))
        out = rows if out is None else out.unionByName(rows)
    return out


register(
    "q_view_totals",
    view_totals,
    sql(
        """SELECT 'sales' AS view, 'All' AS tab, count(*) AS entries, CAST(sum(abs(amount)) AS DOUBLE) AS total FROM vouchers
        UNION ALL SELECT 'sales', voucher_type, count(*), CAST(sum(abs(amount)) AS DOUBLE) FROM vouchers
          WHERE voucher_type IN ('Sales', 'Purchase', 'Receipt', 'Payment') GROUP BY 2
        UNION ALL SELECT 'outstanding', type, NULL, CAST(sum(abs(pending_amount)) AS DOUBLE) FROM outstanding GROUP BY 2
        UNION ALL SELECT 'inventory', 'All', count(*), CAST(sum(abs(closing_value)) AS DOUBLE) FROM stock
        UNION ALL SELECT 'parties', type, count(*), NULL FROM party_rows GROUP BY 2""",
        " party_rows AS (" + PARTIES_SQL + ")",
    ),
)


def pnl_view(m: Model):
    view = R.pnl_view(m.profit_loss)
    rows = view.rows.filter(F.col("section").isNotNull())
    return rows.select("company_id", "section", "particulars", "amount").join(view.totals, "company_id")


register(
    "q_pnl_view",
    pnl_view,
    sql(
        """SELECT company_id, CASE WHEN raw_amount > 0 THEN 'Income' ELSE 'Expenses' END AS section, particulars,
        CAST(amount AS DOUBLE) AS amount, income, expenses, profit, label
        FROM profit_loss JOIN totals USING (company_id) WHERE raw_amount <> 0""",
        f" totals AS ({PNL_SQL})",
    ),
)


def balance_view(m: Model):
    view = R.balance_view(m.balance_sheet)
    return view.rows.select("company_id", "section", "particulars", "amount").join(view.totals, "company_id")


register(
    "q_balance_view",
    balance_view,
    sql(
        """SELECT company_id, CASE WHEN side = 'asset' THEN 'Assets' ELSE 'Liabilities' END AS section, particulars,
        CAST(amount AS DOUBLE) AS amount, total_assets, total_liabilities FROM balance_sheet JOIN totals USING (company_id)""",
        f" totals AS ({BALANCE_SQL})",
    ),
)

# ---- further reports -------------------------------------------------------------------------------------

register(
    "opt_aging_totals",
    lambda m: X.aging_totals(m.outstanding),
    sql(
        """SELECT company_id, type, CASE WHEN days_overdue > 60 THEN '60+' WHEN days_overdue > 30 THEN '30-60' ELSE '0-30' END AS bucket,
        count(*) AS bills, CAST(sum(pending_amount) AS DOUBLE) AS total FROM outstanding GROUP BY 1, 2, 3"""
    ),
)
SALES_KEYS = {"day": "CAST(date AS VARCHAR)", "month": "strftime(date, '%Y-%m')", "party": "party_name"}


def sales_by_all(m: Model) -> DataFrame:
    """The breakdowns by day, month and party below each other."""
    found = None
    for by in SALES_KEYS:
        part = X.sales_breakdown(m.vouchers, by, "1996-01-01", "1999-12-31").withColumnRenamed(by, "key")
        part = part.withColumn("by", F.lit(by))
        found = part if found is None else found.unionByName(part)
    return found


register(
    "opt_sales_breakdown",
    sales_by_all,
    sql(
        " UNION ALL ".join(
            f"""SELECT company_id, {key} AS key, count(*) AS entries, CAST(sum(amount) AS DOUBLE) AS total, '{by}' AS by FROM vouchers
        WHERE voucher_type = 'Sales' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1, 2"""
            for by, key in SALES_KEYS.items()
        )
    ),
)
register(
    "opt_item_sales",
    lambda m: X.item_sales(m.vouchers, m.items),
    sql(
        """SELECT company_id, stock_item_name, CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(i.amount) AS DOUBLE) AS amount
        FROM items i JOIN vouchers v USING (company_id, tally_guid) WHERE voucher_type = 'Sales' GROUP BY 1, 2"""
    ),
)
register(
    "opt_item_movement",
    lambda m: X.item_movement(m.vouchers, m.items),
    sql(
        """SELECT company_id, stock_item_name,
        CAST(sum(CASE WHEN voucher_type IN ('Purchase', 'Receipt', 'Debit Note') THEN quantity ELSE 0 END) AS DOUBLE) AS qty_in,
        CAST(sum(CASE WHEN voucher_type IN ('Sales', 'Payment') THEN quantity ELSE 0 END) AS DOUBLE) AS qty_out
        FROM items i JOIN vouchers v USING (company_id, tally_guid) GROUP BY 1, 2"""
    ),
)
register(
    "opt_low_stock",
    lambda m: X.low_stock(m.stock, 100).select(*STOCK_COLUMNS),
    sql(f"SELECT {STOCK} FROM stock s WHERE s.closing_qty <= 100"),
)
register(
    "opt_cash_bank",
    lambda m: X.cash_bank(m.cash_ledgers.unionByName(m.ledgers, allowMissingColumns=True)),
    sql("SELECT company_id, group_name, CAST(sum(closing_balance) AS DOUBLE) AS balance, count(*) AS ledgers FROM cash_ledgers GROUP BY 1, 2"),
)
register(
    "opt_cash_flow",
    lambda m: X.cash_flow(m.vouchers),
    sql(
        """SELECT company_id, strftime(date, '%Y-%m') AS month,
        CAST(sum(CASE WHEN voucher_type = 'Receipt' THEN amount ELSE 0 END) AS DOUBLE) AS receipts,
        CAST(sum(CASE WHEN voucher_type = 'Payment' THEN amount ELSE 0 END) AS DOUBLE) AS payments,
        CAST(sum(CASE WHEN voucher_type = 'Receipt' THEN amount ELSE -amount END) AS DOUBLE) AS net
        FROM vouchers WHERE voucher_type IN ('Receipt', 'Payment') GROUP BY 1, 2"""
    ),
)
register(
    "opt_group_rollup",
    lambda m: X.group_rollup(m.spark, m.groups, m.segment_ledgers.unionByName(m.supplier_ledgers)),
    sql(
        """SELECT company_id, name, CAST(sum(closing_balance) AS DOUBLE) AS balance FROM (
          SELECT company_id, c_mktsegment, n_name, c_acctbal, unnest([n_name || ' ' || c_mktsegment, n_name, 'Sundry Debtors']) AS name,
            CAST(c_acctbal AS DECIMAL(18,2)) AS closing_balance FROM customers
          UNION ALL SELECT company_id, NULL, NULL, NULL, 'Sundry Creditors', CAST(s_acctbal AS DECIMAL(18,2)) FROM suppliers) GROUP BY 1, 2"""
    ),
)
