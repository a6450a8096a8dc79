"""Queries for merges, change detection, the store and the streamed refresh."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from saldo.operators import changes as C, merge as G, windows as W
from saldo.plans import sync as Y
from saldo.plans.store import LedgerStore
from saldo.queries import envelopes as E
from saldo.queries.model import Model, plain, sql
from saldo.session import new_folder, shuffles_freed
from saldo.sources import responses as R
from saldo.streaming.refresh import start_refresh
from saldo.streaming.totals import day_totals

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CUT = "2024-01-15"


def register(name: str, build, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, folder: plain(build(Model(spark, folder)))
    if oracle:
        ORACLE[name] = oracle


# ---- merges ----------------------------------------------------------------------------------------------

register(
    "union_outstanding",
    lambda m: G.union_outstanding(m.receivables, m.payables).select("party_name", "type", "voucher_number", "pending_amount"),
    sql("SELECT party_name, type, voucher_number, CAST(pending_amount AS DOUBLE) AS pending_amount FROM outstanding"),
)


def newest() -> list:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def feed(m: Model) -> tuple[DataFrame, DataFrame]:
    """State of each user before the cut, and the change feed after it, which lacks ``props``."""
    events = m.table("events")
    cut = F.lit(CUT).cast("timestamp_ntz")
    before = W.latest_per_key(events.filter(F.col("ts") < cut), ["user_id"], newest())
    return before, events.filter(F.col("ts") >= cut)


def upserted(m: Model) -> DataFrame:
    before, after = feed(m)
    batch = after.select("user_id", "event_id", "ts", "event_type", "value")
    return G.upsert(before, batch, ["user_id"], newest()).select("user_id", "event_id", "event_type", "value", "props")


FEED_SQL = f"""WITH ranked AS (
  SELECT *, ts >= TIMESTAMP '{CUT} 00:00:00' AS late FROM events),
old AS (SELECT * FROM ranked WHERE NOT late QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
new AS (SELECT * FROM ranked WHERE late QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""
register(
    "merge_upsert",
    upserted,
    f"""{FEED_SQL} SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id,
      coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.value, o.value) AS value, o.props
    FROM old o FULL JOIN new n ON o.user_id = n.user_id""",
)


def kept_when_empty(m: Model) -> DataFrame:
    """Company rows of which a later batch fills some columns and leaves others blank."""
    old = m.customers.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("gstin"), F.col("n_name").alias("address"))
    rich = F.col("c_acctbal") > 0
    batch = m.customers.filter(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_name").alias("name"),
        F.when(rich, "GST").otherwise(" ").alias("gstin"),
        F.when(~rich, "ADDR").alias("address"),
    )
    return G.keep_when_empty(old, batch, ["name"], ["gstin", "address"])


register(
    "merge_keep_when_empty",
    kept_when_empty,
    sql(
        """SELECT c_name AS name, CASE WHEN c_mktsegment <> 'MACHINERY' AND c_acctbal > 0 THEN 'GST' ELSE c_mktsegment END AS gstin,
        CASE WHEN c_mktsegment <> 'MACHINERY' AND c_acctbal <= 0 THEN 'ADDR' ELSE n_name END AS address FROM customers"""
    ),
)


def replaced_children(m: Model) -> DataFrame:
    """Cancelled and optional vouchers are touched; only the cancelled ones get items again, at no amount."""
    key = ["company_id", "tally_guid"]
    touched = m.vouchers.filter(F.col("is_cancelled") | F.col("is_optional"))
    cancelled = m.items.join(m.vouchers.filter("is_cancelled").select(*key), key, "left_semi")
    new = cancelled.withColumn("amount", F.lit(0).cast("decimal(18,2)"))
    return G.replace_children(m.items, new, touched, key).select(*key, "stock_item_name", "amount")


register(
    "merge_replace_children",
    replaced_children,
    sql(
        """SELECT company_id, tally_guid, stock_item_name, CAST(CASE WHEN is_cancelled THEN 0 ELSE i.amount END AS DOUBLE) AS amount
        FROM items i JOIN vouchers v USING (company_id, tally_guid) WHERE is_cancelled OR NOT is_optional"""
    ),
)


def replaced_section(m: Model) -> DataFrame:
    """Companies 0 and 1 are provided, but rows arrive for company 0 (and, not provided, for 2) only."""
    new = m.payables.filter(F.col("company_id").isin("0", "2")).withColumn("type", F.lit("new")).drop("bill_key")
    provided = m.companies.filter(F.col("company_id").isin("0", "1"))
    return G.replace_section(m.outstanding, new, provided).select("company_id", "party_name", "type", "voucher_number", "pending_amount")


register(
    "merge_replace_section",
    replaced_section,
    sql(
        """SELECT company_id, party_name, type, voucher_number, CAST(pending_amount AS DOUBLE) AS pending_amount FROM outstanding
        WHERE company_id NOT IN ('0', '1')
        UNION ALL SELECT company_id, party_name, 'new', voucher_number, CAST(pending_amount AS DOUBLE) FROM payables WHERE company_id = '0'"""
    ),
)


def cascaded(m: Model) -> DataFrame:
    removed = m.companies.filter(F.col("name").startswith("A"))
    kept = G.cascade_delete({"ledgers": m.ledgers, "vouchers": m.vouchers, "items": m.items}, removed)
    counts = None
    for name, rows in kept.items():
        part = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    return counts


register(
    "merge_cascade_delete",
    cascaded,
    sql(
        """SELECT company_id, count(*) AS n, t AS "table" FROM (
          SELECT company_id, 'ledgers' AS t FROM ledgers UNION ALL SELECT company_id, 'vouchers' FROM vouchers
          UNION ALL SELECT company_id, 'items' FROM items)
        WHERE company_id IN (SELECT company_id FROM companies WHERE name NOT LIKE 'A%') GROUP BY 1, 3"""
    ),
)
register(
    "merge_section_fallback",
    lambda m: G.section_fallback(
        [
            m.receivables.filter(F.col("company_id") < "2").select("company_id", "voucher_number"),
            m.payables.filter(F.col("company_id").between("1", "3")).select("company_id", "voucher_number"),
            m.vouchers.select("company_id", "voucher_number"),
        ]
    ),
    sql(
        """SELECT company_id, voucher_number FROM receivables WHERE company_id < '2'
        UNION ALL SELECT company_id, voucher_number FROM payables WHERE company_id IN ('2', '3')
        UNION ALL SELECT company_id, voucher_number FROM vouchers WHERE company_id > '3'"""
    ),
)

# ---- change detection ------------------------------------------------------------------------------------


def planned(m: Model) -> DataFrame:
    return C.sync_plan(m.marked_companies, m.markers(cached=False), m.markers(cached=True))


register(
    "chg_sync_plan",
    lambda m: planned(m).select(
        "company_id", "has_changes", "master_changed", "voucher_changed", "need_stock", "voucher_sync_mode", "reason"
    ),
    sql("SELECT company_id, has_changes, master_changed, voucher_changed, need_stock, voucher_sync_mode, reason FROM sync_plan"),
)
register(
    "chg_incremental_window",
    lambda m: C.incremental_rows(
        m.table("events").select(F.col("user_id").cast("string").alias("company_id"), "event_id", F.col("ts").cast("date").alias("date")),
        planned(m),
    ),
    sql(
        """SELECT CAST(user_id AS VARCHAR) AS company_id, event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events
        JOIN sync_plan p ON p.company_id = CAST(user_id AS VARCHAR)
        WHERE p.voucher_changed AND CAST(ts AS DATE) BETWEEN p.voucher_from_date AND DATE '2024-12-31'"""
    ),
)
register(
    "chg_skip_unchanged",
    lambda m: C.with_changes(
        m.table("events").select(F.col("user_id").cast("string").alias("company_id"), "event_id"), planned(m)
    ),
    sql(
        """SELECT p.company_id, event_id FROM events JOIN sync_plan p ON p.company_id = CAST(user_id AS VARCHAR) WHERE p.has_changes"""
    ),
)
MARKER_SQL = "company_id, alter_id, alt_vch_id, vch_id, alt_mst_id, CAST(last_voucher_date AS VARCHAR) AS last_voucher_date"
MARKER_COLUMNS = ["company_id", "alter_id", "alt_vch_id", "vch_id", "alt_mst_id", "last_voucher_date"]


def stored_markers(m: Model) -> DataFrame:
    """Cached markers as batch 0 of a store, the current ones of pushed companies as batch 1."""
    store = LedgerStore(m.spark, new_folder(m.spark, "markers"))
    store.write("change_markers", m.markers(cached=True), 0)
    store.commit(0, STAMP)
    pushed = planned(m).filter("need_vouchers")
    store.write("change_markers", C.with_changes(m.markers(cached=False), pushed), 1)
    store.commit(1, STAMP)
    return store.read("change_markers").select(*MARKER_COLUMNS)


STAMP = datetime(2025, 4, 1, tzinfo=timezone.utc)
register(
    "chg_state_store",
    stored_markers,
    sql(
        f"""SELECT {MARKER_SQL} FROM (
          SELECT c.* FROM current_markers c JOIN sync_plan p USING (company_id) WHERE p.voucher_changed
          UNION ALL SELECT k.* FROM cached_markers k
          WHERE k.company_id NOT IN (SELECT c.company_id FROM current_markers c JOIN sync_plan p USING (company_id) WHERE p.voucher_changed)) q"""
    ),
)


def run_log(m: Model) -> DataFrame:
    """Events as a sync log: errors failed, views were skipped, the others succeeded with a count."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "view", "skipped").otherwise("success")
    return m.table("events").select(
        F.col("user_id").cast("string").alias("company_id"),
        F.col("ts").alias("synced_at"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
        F.when(kind == "error", F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error_message"),
        F.when(status == "success", F.create_map(F.lit("vouchers"), F.col("event_id"))).alias("records"),
    )


register(
    "str_latest_status",
    lambda m: C.latest_status(run_log(m)).select(
        "company_id", "last_status", F.date_format("last_synced_at", "yyyy-MM-dd HH:mm:ss").alias("last_synced_at"),
        "last_error", F.coalesce(F.col("last_records")["vouchers"], F.lit(-1)).alias("last_vouchers"),
    ),
    """SELECT CAST(user_id AS VARCHAR) AS company_id,
      CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'error' ELSE 'success' END AS last_status,
      strftime(max(CASE WHEN event_type <> 'error' THEN ts END), '%Y-%m-%d %H:%M:%S') AS last_synced_at,
      CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed ' || arg_max(event_id, (ts, event_id)) END AS last_error,
      coalesce(arg_max(event_id, (ts, event_id)) FILTER (event_type IN ('click', 'signup', 'purchase')), -1) AS last_vouchers
    FROM events GROUP BY user_id""",
)

# ---- sinks and the refresh -------------------------------------------------------------------------------


def landing_rows(m: Model, sections: dict[str, DataFrame], stamp: str) -> DataFrame:
    """Derived envelopes of several sections as landed responses."""
    found = None
    for name, docs in sections.items():
        part = docs.select(
            "company_id", F.lit(name).alias("section"), F.lit(stamp).alias("fetched_at"),
            F.concat_ws("/", F.lit(name), F.col("company_id"), F.col("chunk").cast("string")).alias("path"), "content",
        )
        found = part if found is None else found.unionByName(part)
    return found


def payload_store(m: Model) -> LedgerStore:
    """A store after one refresh with every section of the ledger tables."""
    store = LedgerStore(m.spark, new_folder(m.spark, "store"))
    sections = {
        "groups": E.groups(m), "ledgers": E.ledgers(m), "vouchers": E.vouchers(m), "stock_items": E.stock_items(m),
        "outstanding_receivables": E.bills(m.receivables, "-"), "outstanding_payables": E.bills(m.payables, ""),
        "profit_loss": E.profit_loss(m), "balance_sheet": E.balance_sheet(m), "trial_balance": E.trial_balance(m),
    }
    Y.refresh(store, landing_rows(m, sections, "20250401"), 0, STAMP)
    return store


STORED = ("groups", "ledgers", "vouchers", "voucher_items", "voucher_ledger_entries", "stock_items", "outstanding", "profit_loss", "balance_sheet", "trial_balance")


def stored_counts(m: Model) -> DataFrame:
    store, counts = payload_store(m), None
    for table in STORED:
        part = store.read(table).groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit(table))
        counts = part if counts is None else counts.unionByName(part)
    return counts


def counts_sql(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT company_id, count(*) AS n, '{name}' AS section FROM {view} GROUP BY 1" for name, view in tables.items())


SQL_NAMES = {"groups": "acct_groups", "voucher_items": "items", "voucher_ledger_entries": "entries", "stock_items": "stock"}
register("snk_payload", stored_counts, sql(counts_sql({t: SQL_NAMES.get(t, t) for t in STORED})))
LOGGED = tuple(t for t in STORED if not t.startswith("voucher_"))


def logged(m: Model) -> DataFrame:
    log = payload_store(m).read("sync_log")
    return log.select("company_id", "status", F.explode("records_synced").alias("section", "n"))


register(
    "snk_sync_log",
    logged,
    sql("SELECT company_id, 'success' AS status, section, n FROM (" + counts_sql({t: SQL_NAMES.get(t, t) for t in LOGGED}) + ")"),
)


def land(m: Model, docs: DataFrame, section: str, stamp: str, folder: str, compression: str = "none") -> None:
    """Write envelopes as files of a landing folder, one response per file."""
    texts = R.decode_responses(docs)
    with shuffles_freed(m.spark):
        texts.select(
            F.col("company_id").alias("company"), F.lit(section).alias("section"), F.lit(stamp).alias("fetched_at"),
            F.regexp_replace("text", r"[\r\n]", " ").alias("value"),
        ).write.mode("append").partitionBy("company", "section", "fetched_at").option("maxRecordsPerFile", 1).option(
            "compression", compression
        ).text(folder)


class Changed(Model):
    """The ledger tables some time later: cancelled vouchers are worth more, and creditors moved."""

    @cached_property
    def vouchers(self) -> DataFrame:
        more = F.when(F.col("is_cancelled"), F.col("amount") + 1).otherwise(F.col("amount"))
        return super().vouchers.withColumn("amount", more.cast("decimal(18,2)"))


def run_stream(m: Model, store: LedgerStore, landing: str, checkpoint: str) -> None:
    start_refresh(m.spark, landing, store, checkpoint, every=None, clock=lambda: STAMP).awaitTermination()


def refreshed(m: Model) -> DataFrame:
    """Two runs of the stream: ledgers and vouchers, then the later vouchers of the overlap window."""
    base = new_folder(m.spark, "refresh")
    store = LedgerStore(m.spark, f"{base}/store")
    land(m, E.ledgers(m, E.FILE_ROWS), "ledgers", "20250401", f"{base}/landing", "gzip")
    land(m, E.vouchers(m, E.FILE_ROWS), "vouchers", "20250401", f"{base}/landing", "gzip")
    run_stream(m, store, f"{base}/landing", f"{base}/checkpoint")
    late = Changed(m.spark, m.folder)
    land(m, E.vouchers(late, E.FILE_ROWS), "vouchers", "20250408", f"{base}/landing", "gzip")
    run_stream(m, store, f"{base}/landing", f"{base}/checkpoint")
    return store.read("vouchers")


STREAM_SQL = """SELECT v.company_id, v.tally_guid, voucher_type,
  CAST(CASE WHEN voucher_type = 'Payment' AND i.t IS NOT NULL THEN i.t WHEN is_cancelled THEN v.amount + 1 ELSE v.amount END AS DOUBLE) AS amount
FROM vouchers v LEFT JOIN (SELECT company_id, tally_guid, sum(amount) AS t FROM items GROUP BY 1, 2) i USING (company_id, tally_guid)"""
register("str_periodic_refresh", lambda m: refreshed(m).select("company_id", "tally_guid", "voucher_type", "amount"), sql(STREAM_SQL))


def overlapped(m: Model) -> DataFrame:
    """A refresh of everything, then one that reads only the last seven days again, with changed vouchers."""
    store = LedgerStore(m.spark, new_folder(m.spark, "overlap"))
    Y.refresh(store, landing_rows(m, {"vouchers": E.vouchers(m)}, "20250401"), 0, STAMP)

    class Window(Changed):
        @cached_property
        def vouchers(self) -> DataFrame:
            recent = F.date_sub(F.lit("2001-08-01").cast("date"), C.OVERLAP_DAYS)
            return super().vouchers.filter(F.col("date") >= recent)

    late = Window(m.spark, m.folder)
    Y.refresh(store, landing_rows(m, {"vouchers": E.vouchers(late)}, "20250408"), 1, STAMP)
    return store.read("vouchers")


register(
    "str_late_data_overlap",
    lambda m: overlapped(m).select("company_id", "tally_guid", "voucher_type", "amount"),
    sql(STREAM_SQL.replace("WHEN is_cancelled THEN", "WHEN is_cancelled AND date >= DATE '2001-07-25' THEN")),
)


# ---- fetches in parts, snapshots and removal -------------------------------------------------------------


def parted(m: Model) -> dict[str, DataFrame]:
    """Sections of one fetch, several documents each: ledgers, vouchers, bills and the reports."""
    return {
        "groups": E.groups(m), "ledgers": E.ledgers(m), "vouchers": E.vouchers(m), "stock_items": E.stock_items(m),
        "outstanding_receivables": E.bills(m.receivables, "-"), "outstanding_payables": E.bills(m.payables, ""),
        "profit_loss": E.profit_loss(m), "balance_sheet": E.balance_sheet(m), "trial_balance": E.trial_balance(m),
    }


def split_batches(m: Model) -> DataFrame:
    """One fetch whose documents come in three batches, dealt by a digest of their names, in two orders.

    Both stores are read whole; a row is given with the number of stores that hold it, and how often.
    """
    docs = landing_rows(m, parted(m), "20250401")
    folder = new_folder(m.spark, "documents")
    docs = docs.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(3)))
    docs.write.option("parquet.block.size", Y.TEXT_GROUP).option("compression", Y.PACKED).parquet(folder)
    docs = m.spark.read.parquet(folder)
    orders, rows = ((0, 1, 2), (2, 0, 1)), {}

    def fill(order: tuple[int, ...]) -> None:
        store = LedgerStore(m.spark, new_folder(m.spark, "split"))
        for batch, part in enumerate(order):
            Y.refresh(store, docs.filter(F.col("part") == part).drop("part"), batch, STAMP)
        rows[order] = [named(store, name).withColumn("order", F.lit(str(order))) for name in SPLIT]

    # The stores are filled side by side: most jobs of a refresh are too small to keep the executors busy.
    Y.together([lambda o=order: fill(o) for order in orders])
    found = reduce(DataFrame.unionByName, [one for order in orders for one in rows[order]])
    keys = ["table", "company_id", "name", "amount"]
    return found.groupBy("order", *keys).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stores"), F.min("n").alias("least"), F.max("n").alias("most")
    )


def named(store: LedgerStore, table: str) -> DataFrame:
    """A table of a store as (table, company_id, name, amount)."""
    name, amount = SPLIT[table]
    amount = F.col(amount).cast("decimal(18,2)").alias("amount")
    return store.read(table).select(F.lit(table).alias("table"), "company_id", F.col(name).alias("name"), amount)


SPLIT = {
    "ledgers": ("name", "closing_balance"),
    "vouchers": ("tally_guid", "amount"),
    "voucher_items": ("stock_item_name", "amount"),
    "stock_items": ("name", "closing_value"),
    "outstanding": ("voucher_number", "pending_amount"),
    "profit_loss": ("particulars", "amount"),
    "balance_sheet": ("particulars", "amount"),
    "trial_balance": ("particulars", "debit"),
}
# A voucher of amount 0 shows its items' total.
AMOUNTS_SQL = """(SELECT company_id, tally_guid, CASE WHEN voucher_type = 'Payment' AND t IS NOT NULL THEN t ELSE amount END AS amount
  FROM vouchers LEFT JOIN (SELECT company_id, tally_guid, sum(amount) AS t FROM items GROUP BY 1, 2) USING (company_id, tally_guid))"""
SPLIT_SQL = " UNION ALL ".join(
    f"""SELECT '{table}' AS "table", company_id, CAST({name} AS VARCHAR) AS name, CAST({amount} AS DOUBLE) AS amount FROM {view}"""
    for table, name, amount, view in (
        ("ledgers", "name", "closing_balance", "ledgers"), ("vouchers", "tally_guid", "amount", AMOUNTS_SQL),
        ("voucher_items", "stock_item_name", "amount", "items"), ("stock_items", "name", "closing_value", "stock"),
        ("outstanding", "voucher_number", "pending_amount", "outstanding"), ("profit_loss", "particulars", "amount", "profit_loss"),
        ("balance_sheet", "particulars", "amount", "balance_sheet"), ("trial_balance", "particulars", "debit", "trial_balance"),
    )
)
register(
    "str_split_batches",
    split_batches,
    sql(f"""SELECT "table", company_id, name, amount, 2 AS stores, count(*) AS least, count(*) AS most FROM ({SPLIT_SQL}) GROUP BY 1, 2, 3, 4"""),
)


class Fewer(Model):
    """The ledger tables some time later: debtors that owe nothing have left."""

    @cached_property
    def ledgers(self) -> DataFrame:
        return super().ledgers.filter((F.col("group_name") != "Sundry Debtors") | (F.col("closing_balance") > 0))


def snapshot_store(m: Model) -> DataFrame:
    """Two whole fetches of the ledgers as snapshots, the later one first: what it does not list is gone."""
    store = LedgerStore(m.spark, new_folder(m.spark, "snapshots"))
    later = landing_rows(m, parted(Fewer(m.spark, m.folder)), "20250408")
    Y.refresh(store, later, 0, STAMP, full_snapshot=True)
    Y.refresh(store, landing_rows(m, {"ledgers": E.ledgers(m)}, "20250401"), 1, STAMP, full_snapshot=True)
    return store.read("ledgers")


register(
    "merge_full_snapshot",
    lambda m: snapshot_store(m).select("company_id", "name", "group_name", "closing_balance"),
    sql(
        """SELECT company_id, name, group_name, CAST(closing_balance AS DOUBLE) AS closing_balance FROM ledgers
        WHERE group_name <> 'Sundry Debtors' OR closing_balance > 0"""
    ),
)


def removed_companies(m: Model) -> DataFrame:
    """A store from which companies with an A are removed; one of them comes back with its ledgers only."""
    store = LedgerStore(m.spark, new_folder(m.spark, "removal"))
    sections = {"ledgers": E.ledgers(m), "vouchers": E.vouchers(m), "profit_loss": E.profit_loss(m)}
    Y.refresh(store, landing_rows(m, sections, "20250401"), 0, STAMP)
    store.remove_companies(m.companies.filter(F.col("name").startswith("A")), "20250401")
    back = m.companies.filter(F.col("name") == "ASIA")
    Y.refresh(store, landing_rows(m, {"ledgers": E.ledgers(m)}, "20250408"), 1, STAMP, enabled=back)
    store.compact(everything=True)
    found = None
    for name in ("ledgers", "vouchers", "voucher_items", "profit_loss"):
        rows = named(store, name)
        found = rows if found is None else found.unionByName(rows)
    return found


register(
    "merge_remove_company",
    removed_companies,
    sql(
        f"""SELECT "table", s.company_id, s.name, amount FROM ({SPLIT_SQL}) s JOIN companies c USING (company_id)
        WHERE "table" IN ('ledgers', 'vouchers', 'voucher_items', 'profit_loss')
        AND (c.name NOT LIKE 'A%' OR (c.name = 'ASIA' AND "table" = 'ledgers'))"""
    ),
)


def stored_window(m: Model) -> DataFrame:
    """The vouchers of each company's planned window, read from a store by month."""
    store = LedgerStore(m.spark, new_folder(m.spark, "window"))
    store.write("vouchers", m.vouchers.withColumn("fetched_at", F.lit("1")), 0)
    store.commit(0, STAMP)
    windows = m.companies.select(
        "company_id",
        F.make_date(F.lit(1995) + F.col("company_id").cast("int") % 3, F.lit(3), F.lit(10)).alias("from_date"),
        F.make_date(F.lit(1995) + F.col("company_id").cast("int") % 3, F.lit(5), F.lit(2)).alias("to_date"),
    )
    return store.vouchers_between(windows.filter(F.col("company_id") != "2"))


register(
    "chg_stored_window",
    lambda m: stored_window(m).select("company_id", "tally_guid", F.col("date").cast("string").alias("date"), "amount"),
    sql(
        """SELECT company_id, tally_guid, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount FROM vouchers
        WHERE company_id <> '2' AND date BETWEEN make_date(1995 + CAST(company_id AS INT) % 3, 3, 10) AND make_date(1995 + CAST(company_id AS INT) % 3, 5, 2)"""
    ),
)

TOTALS_CUT = "1997-06-30"


def streamed_totals(m: Model) -> DataFrame:
    """Day totals of a stream: vouchers up to a day, then later ones together with optional ones that come late, then an end."""
    base = new_folder(m.spark, "totals")
    columns = ["company_id", "tally_guid", "voucher_type", "date", "amount"]
    rows, early = m.vouchers, (F.col("date") <= F.lit(TOTALS_CUT).cast("date")) & ~F.col("is_optional")
    end = m.spark.range(1).select(
        F.lit("end").alias("company_id"), F.lit("end").alias("tally_guid"), F.lit("Sales").alias("voucher_type"),
        F.lit("2100-01-01").cast("date").alias("date"), F.lit(0).cast("decimal(18,2)").alias("amount"),
    )
    for batch in (rows.filter(early), rows.filter(~early), end):
        batch.select(*columns).write.mode("append").parquet(f"{base}/vouchers")
        stream = m.spark.readStream.schema(rows.select(*columns).schema).parquet(f"{base}/vouchers")
        query = day_totals(stream).writeStream.format("parquet").option("path", f"{base}/totals")
        query.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.parquet(f"{base}/totals")


register(
    "str_day_totals",
    lambda m: streamed_totals(m).select("company_id", "voucher_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "entries", "total"),
    sql(
        f"""SELECT company_id, voucher_type, CAST(date AS VARCHAR) AS day, count(*) AS entries, CAST(sum(abs(amount)) AS DOUBLE) AS total
        FROM vouchers WHERE (date <= DATE '{TOTALS_CUT}' AND NOT is_optional) OR date > (
          SELECT max(date) - 7 FROM vouchers WHERE date <= DATE '{TOTALS_CUT}' AND NOT is_optional)
        GROUP BY 1, 2, 3"""
    ),
)
