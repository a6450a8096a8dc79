"""The given tables seen as ledger tables: once as DataFrames, once as the same definitions in SQL.

region -> companies, customer and supplier -> ledgers, orders -> vouchers, lineitem -> voucher items,
part -> stock items, open orders and lines -> outstanding bills, events -> change feed (one company per user).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saldo.schema import MONEY

AS_OF = "2001-08-01"
CACHED_UNTIL = "2024-01-30"
MONEY_SQL = "DECIMAL(18,2)"

VOUCHER_TYPES = {"1": "Sales", "2": "Purchase", "3": "Receipt", "4": "Payment", "5": "Debit Note"}


def money(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def text(c) -> Column:
    return F.col(c).cast("string")


class Model:
    """Ledger tables over one folder of Parquet files, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._scans: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._scans:
            self._scans[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._scans[name]

    @cached_property
    def places(self) -> DataFrame:
        """Nation with its company; one row per nation."""
        region = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        return self.table("nation").join(region, "n_regionkey").select(
            "n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("company_id"), "r_name"
        )

    def placed(self, table: str, key: str) -> DataFrame:
        """A table with the place of each row's nation."""
        return self.table(table).join(self.places, F.col(key) == F.col("n_nationkey"))

    @cached_property
    def companies(self) -> DataFrame:
        return self.table("region").select(text("r_regionkey").alias("company_id"), F.col("r_name").alias("name"))

    @cached_property
    def customers(self) -> DataFrame:
        return self.placed("customer", "c_nationkey")

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.placed("supplier", "s_nationkey")

    @cached_property
    def vouchers(self) -> DataFrame:
        pairs = ", ".join(f"'{digit}', '{name}'" for digit, name in VOUCHER_TYPES.items())
        kind = F.expr(f"map({pairs})[substring(o_orderpriority, 1, 1)]")
        return self.table("orders").join(self.customers, F.col("o_custkey") == F.col("c_custkey")).select(
            "company_id",
            text("o_orderkey").alias("tally_guid"),
            F.concat(F.lit("VCH-"), text("o_orderkey")).alias("voucher_number"),
            kind.alias("voucher_type"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("c_name").alias("party_name"),
            money("o_totalprice").alias("amount"),
            F.concat("o_orderpriority", F.lit(" & <"), "o_orderstatus", F.lit(">")).alias("narration"),
            F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("REF-"), text("o_custkey"))).alias("reference"),
            (F.col("o_orderstatus") == "P").alias("is_cancelled"),
            (F.col("o_totalprice") < 10000).alias("is_optional"),
            (kind == "Sales").alias("is_invoice"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Voucher items. The rate is the amount per unit, cut to two decimals with whole numbers."""
        whole = F.expr("CAST(round(l_extendedprice * 100) AS BIGINT) div CAST(l_quantity AS BIGINT)")
        part = self.table("part").select("p_partkey", item_name().alias("stock_item_name"))
        keys = self.vouchers.select("company_id", "tally_guid")
        return (
            self.table("lineitem")
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                text("l_orderkey").alias("tally_guid"),
                "stock_item_name",
                F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
                F.lit("Nos").alias("unit"),
                (whole.cast("decimal(18,2)") / F.lit(100)).cast("decimal(18,4)").alias("rate"),
                F.round(F.col("l_discount") * 100).cast("decimal(18,4)").alias("discount_pct"),
                money("l_extendedprice").alias("amount"),
                (F.col("l_linenumber") - 1).cast("int").alias("line"),
            )
            .join(keys, "tally_guid")
            .select("company_id", "tally_guid", "line", "stock_item_name", "quantity", "unit", "rate", "discount_pct", "amount")
        )

    @cached_property
    def entries(self) -> DataFrame:
        """Two ledger entries per voucher: the party's, with a bill, and the account's."""
        bill = F.struct(
            F.col("voucher_number").alias("name"), F.lit("New Ref").alias("bill_type"), F.col("amount").alias("amount")
        )
        none = F.array().cast("array<struct<name:string,bill_type:string,amount:decimal(18,2)>>")

        def entry(name, amount, party, bills):
            return F.struct(
                name.alias("ledger_name"),
                amount.cast(MONEY).alias("amount"),
                F.lit(party).alias("is_party_ledger"),
                F.lit(party).alias("is_deemed_positive"),
                bills.alias("bill_allocations"),
            )

        pair = F.array(
            entry(F.col("party_name"), -F.col("amount"), True, F.array(bill).cast(none_type())),
            entry(F.concat("voucher_type", F.lit(" Account")), F.col("amount"), False, none),
        )
        return self.vouchers.select("company_id", "tally_guid", F.explode(pair).alias("e")).select(
            "company_id", "tally_guid", "e.*"
        )

    @cached_property
    def ledgers(self) -> DataFrame:
        debtors = self.customers.select(
            "company_id", F.col("c_name").alias("name"), F.lit("Sundry Debtors").alias("group_name"),
            money("c_acctbal").alias("closing_balance"), F.col("c_custkey").alias("master_id"),
            F.col("n_name").alias("state"), F.col("r_name").alias("country"),
            F.concat(F.lit("C"), text("c_custkey")).alias("guid"),
        )
        creditors = self.suppliers.select(
            "company_id", F.col("s_name").alias("name"), F.lit("Sundry Creditors").alias("group_name"),
            money("s_acctbal").alias("closing_balance"), F.col("s_suppkey").alias("master_id"),
            F.col("n_name").alias("state"), F.col("r_name").alias("country"),
            F.concat(F.lit("S"), text("s_suppkey")).alias("guid"),
        )
        return debtors.unionByName(creditors)

    @cached_property
    def segment_ledgers(self) -> DataFrame:
        """Customer ledgers under the lowest level of ``groups``."""
        return self.customers.select(
            "company_id", F.col("c_name").alias("name"),
            F.concat_ws(" ", "n_name", "c_mktsegment").alias("group_name"),
            money("c_acctbal").alias("closing_balance"),
        )

    @cached_property
    def supplier_ledgers(self) -> DataFrame:
        """Supplier ledgers, whose group has no row in ``groups``."""
        return self.suppliers.select(
            "company_id", F.col("s_name").alias("name"), F.lit("Sundry Creditors").alias("group_name"),
            money("s_acctbal").alias("closing_balance"),
        )

    @cached_property
    def groups(self) -> DataFrame:
        """Sundry Debtors > nation > nation and segment, as far as customers use them."""
        lowest = self.customers.groupBy("company_id", "n_name", "c_mktsegment").agg(F.min("c_custkey").alias("master_id"))
        segments = lowest.select(
            "company_id", F.concat_ws(" ", "n_name", "c_mktsegment").alias("name"), F.col("n_name").alias("parent"), "master_id"
        )
        nations = lowest.groupBy("company_id", F.col("n_name").alias("name")).agg(F.min("master_id").alias("master_id"))
        tops = lowest.groupBy("company_id").agg(F.min("master_id").alias("master_id"))
        return (
            segments.unionByName(nations.withColumn("parent", F.lit("Sundry Debtors")))
            .unionByName(tops.withColumn("name", F.lit("Sundry Debtors")).withColumn("parent", F.lit("")))
            .select("company_id", "name", "parent", "master_id")
        )

    @cached_property
    def cash_ledgers(self) -> DataFrame:
        """A bank and a cash ledger per nation, out of the receipts and payments of its customers."""
        orders = self.table("orders").join(self.customers, F.col("o_custkey") == F.col("c_custkey"))
        kind = F.substring("o_orderpriority", 1, 1)
        flows = orders.filter(kind.isin("3", "4")).select(
            "company_id",
            F.concat(F.when(F.col("o_orderstatus") == "F", "Cash ").otherwise("Bank "), F.col("n_name")).alias("name"),
            F.when(F.col("o_orderstatus") == "F", "Cash-in-Hand").otherwise("Bank Accounts").alias("group_name"),
            F.when(kind == "3", money("o_totalprice")).otherwise(-money("o_totalprice")).alias("flow"),
        )
        return flows.groupBy("company_id", "name", "group_name").agg(money(F.sum("flow")).alias("closing_balance"))

    @cached_property
    def stock(self) -> DataFrame:
        """Stock items; lines of status F came in, those of status O went out."""
        moved = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
        sums = self.table("lineitem").groupBy("l_partkey").agg(F.sum(moved.cast("bigint")).alias("moved"))
        signed = F.coalesce("moved", F.lit(0)).cast("decimal(18,4)")
        return (
            self.table("part")
            .join(sums, F.col("p_partkey") == F.col("l_partkey"), "left")
            .select(
                (F.col("p_partkey") % 5).cast("string").alias("company_id"),
                "p_partkey",
                item_name().alias("name"),
                F.col("p_brand").alias("group_name"),
                F.lit("Nos").alias("unit"),
                F.abs(signed).alias("closing_qty"),
                signed.alias("signed_qty"),
                (F.abs(signed).cast("decimal(14,0)") * F.col("p_retailprice").cast("decimal(12,2)")).cast(MONEY).alias("closing_value"),
                F.col("p_retailprice").cast("decimal(18,4)").alias("rate"),
            )
        )

    @cached_property
    def receivables(self) -> DataFrame:
        due = F.date_add(F.col("o_orderdate").cast("date"), 30)
        orders = self.table("orders").filter(F.col("o_orderstatus") == "O")
        return orders.join(self.customers, F.col("o_custkey") == F.col("c_custkey")).select(
            "company_id", F.col("o_orderkey").alias("bill_key"), F.col("c_name").alias("party_name"),
            F.lit("receivable").alias("type"), F.concat(F.lit("VCH-"), text("o_orderkey")).alias("voucher_number"),
            F.col("o_orderdate").cast("date").alias("voucher_date"), due.alias("due_date"),
            money("o_totalprice").alias("original_amount"), money("o_totalprice").alias("pending_amount"),
            overdue(due).alias("days_overdue"),
        )

    @cached_property
    def payables(self) -> DataFrame:
        """Open lines added up to one bill per supplier and order, before the join."""
        bills = (
            self.table("lineitem")
            .filter(F.col("l_linestatus") == "O")
            .groupBy("l_suppkey", "l_orderkey")
            .agg(F.min("l_shipdate").cast("date").alias("day"), F.sum(money("l_extendedprice")).cast(MONEY).alias("owed"))
        )
        due = F.date_add("day", 30)
        return bills.join(self.suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "company_id", F.col("l_orderkey").alias("bill_key"), F.col("s_name").alias("party_name"),
            F.lit("payable").alias("type"),
            F.concat(F.lit("PUR-"), text("l_orderkey"), F.lit("-"), text("l_suppkey")).alias("voucher_number"),
            F.col("day").alias("voucher_date"), due.alias("due_date"),
            F.col("owed").alias("original_amount"), F.col("owed").alias("pending_amount"),
            overdue(due).alias("days_overdue"),
        )

    @cached_property
    def outstanding(self) -> DataFrame:
        return self.receivables.unionByName(self.payables).drop("bill_key")

    @cached_property
    def profit_loss(self) -> DataFrame:
        """Month by type. Sales and purchases are main rows, receipts and payments sub rows, the rest is empty."""
        sums = self.vouchers.groupBy(
            "company_id", F.date_format("date", "yyyy-MM").alias("month"), "voucher_type"
        ).agg(F.sum("amount").cast(MONEY).alias("total"))
        kind = F.col("voucher_type")
        sign = F.when(kind.isin("Sales", "Receipt"), 1).when(kind.isin("Purchase", "Payment"), -1).otherwise(0)
        level = F.when(kind.isin("Sales", "Purchase"), "main").when(kind.isin("Receipt", "Payment"), "sub").otherwise("none")
        return (
            sums.withColumn("particulars", F.concat_ws(" ", "voucher_type", "month"))
            .withColumn("raw_amount", (F.col("total") * sign).cast(MONEY))
            .withColumn("amount", F.abs("raw_amount"))
            .withColumn("is_debit", F.col("raw_amount") >= 0)
            .withColumn("is_income", F.col("raw_amount") > 0)
            .withColumn("level", level)
            .select("company_id", "month", "particulars", "raw_amount", "amount", "is_debit", "is_income", "level")
        )

    @cached_property
    def balance_sheet(self) -> DataFrame:
        """Customer balances (main, negative), supplier balances (sub) and stock by brand (debit column)."""
        debt = self.customers.groupBy("company_id", "n_name", "c_mktsegment").agg(money(F.sum(money("c_acctbal"))).alias("v"))
        owed = self.suppliers.groupBy("company_id", "n_name").agg(money(F.sum(money("s_acctbal"))).alias("v"))
        held = self.stock.groupBy("company_id", "group_name").agg(money(F.sum("closing_value")).alias("v"))
        no = F.lit(None).cast(MONEY)
        rows = (
            debt.select("company_id", F.concat_ws(" ", F.lit("Debtors"), "n_name", "c_mktsegment").alias("particulars"),
                        (-F.col("v")).cast(MONEY).alias("main"), no.alias("sub"), no.alias("debit"))
            .unionByName(owed.select("company_id", F.concat_ws(" ", F.lit("Creditors"), "n_name").alias("particulars"),
                                     no.alias("main"), F.col("v").alias("sub"), no.alias("debit")))
            .unionByName(held.select("company_id", F.concat_ws(" ", F.lit("Stock"), "group_name").alias("particulars"),
                                     no.alias("main"), no.alias("sub"), F.col("v").alias("debit")))
        )
        raw = F.coalesce("main", "sub")
        return (
            rows.withColumn("side", F.when(raw > 0, "liability").when(raw.isNotNull(), "asset")
                            .when(F.col("debit") != 0, "asset").otherwise("liability"))
            .withColumn("amount", F.abs(F.coalesce("main", "sub", "debit")))
        )

    @cached_property
    def trial_balance(self) -> DataFrame:
        """Debit and credit of every ledger the vouchers touch; each voucher balances."""
        sums = self.entries.groupBy("company_id", F.col("ledger_name").alias("particulars"))
        return sums.agg(
            money(F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(F.lit(0)))).alias("debit"),
            money(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(0)))).alias("credit"),
        )

    def markers(self, cached: bool) -> DataFrame:
        """Change markers per user of ``events``; the cached ones stop earlier, and both lack some users."""
        events = self.table("events")
        if cached:
            events = events.filter(F.col("ts") < F.lit(CACHED_UNTIL).cast("timestamp_ntz"))
            known = (F.col("event_type") == "click") & (F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz"))
        else:
            known = (F.col("event_type") == "view") & (F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))
        bought = F.col("event_type") == "purchase"
        return (
            events.groupBy(text("user_id").alias("company_id"))
            .agg(
                F.max("event_id").cast("string").alias("alter_id"),
                F.count(F.when(bought, 1)).cast("string").alias("alt_vch_id"),
                F.coalesce(F.max(F.when(bought, F.col("event_id"))), F.lit(0)).cast("string").alias("vch_id"),
                F.count(F.when(F.col("event_type") == "signup", 1)).cast("string").alias("alt_mst_id"),
                F.max(F.when(bought, F.col("ts").cast("date"))).alias("last_voucher_date"),
                F.max(known).alias("known"),
            )
            .filter("known")
            .drop("known")
        )

    @cached_property
    def marked_companies(self) -> DataFrame:
        users = self.table("events").select(text("user_id").alias("company_id")).distinct()
        return users.withColumn("fy_from", F.lit("2024-01-10").cast("date")).withColumn("fy_to", F.lit("2024-12-31").cast("date"))


def item_name() -> Column:
    return F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"))


def none_type() -> str:
    return "array<struct<name:string,bill_type:string,amount:decimal(18,2)>>"


def overdue(due: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.lit(AS_OF).cast("date"), due))


# ---- the same definitions as SQL ------------------------------------------------------------------------

VIEWS = f"""
places AS (
  SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS company_id, r_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
companies AS (SELECT CAST(r_regionkey AS VARCHAR) AS company_id, r_name AS name FROM region),
customers AS (SELECT * FROM customer JOIN places ON c_nationkey = n_nationkey),
suppliers AS (SELECT * FROM supplier JOIN places ON s_nationkey = n_nationkey),
vouchers AS (
  SELECT company_id, CAST(o_orderkey AS VARCHAR) AS tally_guid, 'VCH-' || o_orderkey AS voucher_number,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Sales' WHEN '2' THEN 'Purchase' WHEN '3' THEN 'Receipt'
      WHEN '4' THEN 'Payment' WHEN '5' THEN 'Debit Note' END AS voucher_type,
    CAST(o_orderdate AS DATE) AS date, c_name AS party_name, CAST(o_totalprice AS {MONEY_SQL}) AS amount,
    o_orderpriority || ' & <' || o_orderstatus || '>' AS narration,
    CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'REF-' || o_custkey END AS reference,
    o_orderstatus = 'P' AS is_cancelled, o_totalprice < 10000 AS is_optional,
    substr(o_orderpriority, 1, 1) = '1' AS is_invoice
  FROM orders JOIN customers ON o_custkey = c_custkey),
items AS (
  SELECT company_id, tally_guid, l_linenumber - 1 AS line, p_name || ' #' || p_partkey AS stock_item_name,
    CAST(l_quantity AS DECIMAL(18,4)) AS quantity, 'Nos' AS unit,
    CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,4)) AS rate,
    CAST(round(l_discount * 100) AS DECIMAL(18,4)) AS discount_pct, CAST(l_extendedprice AS {MONEY_SQL}) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN (SELECT company_id, tally_guid FROM vouchers) v ON v.tally_guid = CAST(l_orderkey AS VARCHAR)),
entries AS (
  SELECT company_id, tally_guid, party_name AS ledger_name, CAST(-amount AS {MONEY_SQL}) AS amount,
    TRUE AS is_party_ledger, TRUE AS is_deemed_positive, voucher_number AS bill_name FROM vouchers
  UNION ALL
  SELECT company_id, tally_guid, voucher_type || ' Account', amount, FALSE, FALSE, NULL FROM vouchers),
ledgers AS (
  SELECT company_id, c_name AS name, 'Sundry Debtors' AS group_name, CAST(c_acctbal AS {MONEY_SQL}) AS closing_balance,
    c_custkey AS master_id, n_name AS state, r_name AS country, 'C' || c_custkey AS guid FROM customers
  UNION ALL
  SELECT company_id, s_name, 'Sundry Creditors', CAST(s_acctbal AS {MONEY_SQL}), s_suppkey, n_name, r_name,
    'S' || s_suppkey FROM suppliers),
segment_ledgers AS (
  SELECT company_id, c_name AS name, n_name || ' ' || c_mktsegment AS group_name,
    CAST(c_acctbal AS {MONEY_SQL}) AS closing_balance FROM customers),
acct_groups AS (
  SELECT company_id, n_name || ' ' || c_mktsegment AS name, n_name AS parent, min(c_custkey) AS master_id
  FROM customers GROUP BY company_id, n_name, c_mktsegment
  UNION ALL SELECT company_id, n_name, 'Sundry Debtors', min(c_custkey) FROM customers GROUP BY company_id, n_name
  UNION ALL SELECT company_id, 'Sundry Debtors', '', min(c_custkey) FROM customers GROUP BY company_id),
cash_ledgers AS (
  SELECT company_id, CASE WHEN o_orderstatus = 'F' THEN 'Cash ' ELSE 'Bank ' END || n_name AS name,
    CASE WHEN o_orderstatus = 'F' THEN 'Cash-in-Hand' ELSE 'Bank Accounts' END AS group_name,
    sum(CAST(CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN o_totalprice ELSE -o_totalprice END AS {MONEY_SQL})) AS closing_balance
  FROM orders JOIN customers ON o_custkey = c_custkey
  WHERE substr(o_orderpriority, 1, 1) IN ('3', '4') GROUP BY 1, 2, 3),
stock AS (
  SELECT CAST(p_partkey % 5 AS VARCHAR) AS company_id, p_name || ' #' || p_partkey AS name, p_brand AS group_name,
    'Nos' AS unit, abs(coalesce(moved, 0)) AS closing_qty, coalesce(moved, 0) AS signed_qty,
    CAST(abs(coalesce(moved, 0)) * CAST(p_retailprice AS {MONEY_SQL}) AS {MONEY_SQL}) AS closing_value,
    CAST(p_retailprice AS {MONEY_SQL}) AS rate
  FROM part LEFT JOIN (
    SELECT l_partkey, CAST(sum(CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END AS BIGINT)) AS BIGINT) AS moved
    FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey),
receivables AS (
  SELECT company_id, c_name AS party_name, 'receivable' AS type, 'VCH-' || o_orderkey AS voucher_number,
    CAST(o_orderdate AS DATE) AS voucher_date, CAST(o_orderdate AS DATE) + 30 AS due_date,
    CAST(o_totalprice AS {MONEY_SQL}) AS original_amount, CAST(o_totalprice AS {MONEY_SQL}) AS pending_amount,
    greatest(0, DATE '{AS_OF}' - (CAST(o_orderdate AS DATE) + 30)) AS days_overdue
  FROM orders JOIN customers ON o_custkey = c_custkey WHERE o_orderstatus = 'O'),
payables AS (
  SELECT company_id, s_name AS party_name, 'payable' AS type, 'PUR-' || l_orderkey || '-' || l_suppkey AS voucher_number,
    day AS voucher_date, day + 30 AS due_date, owed AS original_amount, owed AS pending_amount,
    greatest(0, DATE '{AS_OF}' - (day + 30)) AS days_overdue
  FROM (SELECT l_suppkey, l_orderkey, CAST(min(l_shipdate) AS DATE) AS day,
          CAST(sum(CAST(l_extendedprice AS {MONEY_SQL})) AS {MONEY_SQL}) AS owed
        FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey, l_orderkey)
  JOIN suppliers ON l_suppkey = s_suppkey),
outstanding AS (SELECT * FROM receivables UNION ALL SELECT * FROM payables),
profit_loss AS (
  SELECT company_id, voucher_type || ' ' || month AS particulars, raw_amount, abs(raw_amount) AS amount,
    raw_amount >= 0 AS is_debit, raw_amount > 0 AS is_income, level
  FROM (SELECT company_id, strftime(date, '%Y-%m') AS month, voucher_type,
      sum(amount) * CASE WHEN voucher_type IN ('Sales', 'Receipt') THEN 1 WHEN voucher_type IN ('Purchase', 'Payment') THEN -1 ELSE 0 END AS raw_amount,
      CASE WHEN voucher_type IN ('Sales', 'Purchase') THEN 'main' WHEN voucher_type IN ('Receipt', 'Payment') THEN 'sub' ELSE 'none' END AS level
    FROM vouchers GROUP BY 1, 2, 3)),
balance_sheet AS (
  SELECT company_id, particulars,
    CASE WHEN raw IS NOT NULL THEN CASE WHEN raw > 0 THEN 'liability' ELSE 'asset' END
      WHEN debit <> 0 THEN 'asset' ELSE 'liability' END AS side,
    abs(coalesce(raw, debit)) AS amount
  FROM (
    SELECT company_id, 'Debtors ' || n_name || ' ' || c_mktsegment AS particulars, -sum(CAST(c_acctbal AS {MONEY_SQL})) AS raw, NULL AS debit
    FROM customers GROUP BY company_id, n_name, c_mktsegment
    UNION ALL SELECT company_id, 'Creditors ' || n_name, sum(CAST(s_acctbal AS {MONEY_SQL})), NULL FROM suppliers GROUP BY company_id, n_name
    UNION ALL SELECT company_id, 'Stock ' || group_name, NULL, sum(closing_value) FROM stock GROUP BY company_id, group_name)),
trial_balance AS (
  SELECT company_id, ledger_name AS particulars, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS debit,
    sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS credit
  FROM entries GROUP BY company_id, ledger_name),
current_markers AS (
  SELECT CAST(user_id AS VARCHAR) AS company_id, CAST(max(event_id) AS VARCHAR) AS alter_id,
    CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS VARCHAR) AS alt_vch_id,
    CAST(coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), 0) AS VARCHAR) AS vch_id,
    CAST(count(CASE WHEN event_type = 'signup' THEN 1 END) AS VARCHAR) AS alt_mst_id,
    max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS last_voucher_date
  FROM events GROUP BY user_id
  HAVING bool_or(event_type = 'view' AND ts >= TIMESTAMP '2024-01-24 00:00:00')),
cached_markers AS (
  SELECT CAST(user_id AS VARCHAR) AS company_id, CAST(max(event_id) AS VARCHAR) AS alter_id,
    CAST(count(CASE WHEN event_type = 'purchase' THEN 1 END) AS VARCHAR) AS alt_vch_id,
    CAST(coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), 0) AS VARCHAR) AS vch_id,
    CAST(count(CASE WHEN event_type = 'signup' THEN 1 END) AS VARCHAR) AS alt_mst_id,
    max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS last_voucher_date
  FROM events WHERE ts < TIMESTAMP '{CACHED_UNTIL} 00:00:00' GROUP BY user_id
  HAVING bool_or(event_type = 'click' AND ts < TIMESTAMP '2024-01-05 00:00:00')),
plans AS (
  SELECT u.company_id, c.company_id IS NULL AS no_current, k.company_id IS NULL AS no_cached,
    c.alter_id <> k.alter_id AS company_d, (c.alt_vch_id <> k.alt_vch_id OR c.vch_id <> k.vch_id) AS voucher_d,
    c.alt_mst_id <> k.alt_mst_id AS master_d, c.last_voucher_date AS now_last, k.last_voucher_date AS old_last
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS company_id FROM events) u
  LEFT JOIN current_markers c ON c.company_id = u.company_id LEFT JOIN cached_markers k ON k.company_id = u.company_id),
flags AS (
  SELECT *, no_current OR no_cached AS everything,
    no_current OR no_cached OR voucher_d AS voucher_changed,
    no_current OR no_cached OR master_d OR (company_d AND NOT voucher_d) AS master_changed,
    no_current OR no_cached OR company_d OR voucher_d OR master_d AS has_changes FROM plans),
sync_plan AS (
  SELECT company_id, has_changes, master_changed, voucher_changed,
    master_changed OR voucher_changed AS need_stock,
    CASE WHEN NOT has_changes THEN 'skipped' WHEN NOT everything AND voucher_changed AND coalesce(now_last > old_last, FALSE) THEN 'incremental'
      WHEN voucher_changed THEN 'full' ELSE 'none' END AS voucher_sync_mode,
    CASE WHEN no_current THEN 'missing_change_markers' WHEN no_cached THEN 'first_successful_sync'
      WHEN NOT has_changes THEN 'no_changes' ELSE 'changes_detected' END AS reason,
    CASE WHEN NOT has_changes THEN NULL
      WHEN NOT everything AND voucher_changed AND coalesce(now_last > old_last, FALSE) THEN greatest(DATE '2024-01-10', old_last - 7)
      ELSE DATE '2024-01-10' END AS voucher_from_date
  FROM flags)
"""


def sql(select: str, extra: str = "") -> str:
    """``select`` over the ledger tables; ``extra`` adds further named subqueries."""
    return f"WITH {VIEWS.strip()}{',' + extra if extra else ''}\n{select.strip()}"


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types both engines print alike: text, whole numbers, doubles and booleans."""
    casts = {"date": "string", "int": "bigint", "smallint": "bigint", "float": "double"}
    out = []
    for name, kind in df.dtypes:
        kind = "double" if kind.startswith("decimal") else casts.get(kind, kind)
        out.append(F.col(f"`{name}`").cast(kind).alias(name))
    return df.select(*out)
