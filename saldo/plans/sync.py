"""A refresh: landed responses -> staged rows -> what each fetch counts for -> one committed batch of the store."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from saldo.files import Folder
from saldo.functions import scalars as S
from saldo.operators import changes as C, merge as G
from saldo.plans import store as T
from saldo.plans.store import GUARDED, ORIGINS, LedgerStore
from saldo.session import shuffles_freed
from saldo.sources import large as L, responses as R, sections as D
from saldo.sources.definitions import parse_documents, staged_rows

# Stored table -> the plan's flag that asks for it.
FLAGS = {
    "groups": "need_groups",
    "ledgers": "need_ledgers",
    "vouchers": "need_vouchers",
    "stock_items": "need_stock",
    "outstanding": "need_outstanding",
    "profit_loss": "need_reports",
    "balance_sheet": "need_reports",
    "trial_balance": "need_reports",
}
SOURCES = {table: (ORIGINS.get(table, (table,)), flag) for table, flag in FLAGS.items()}

# Tables of which either section will do; of the others all are needed.
EITHER = ("stock_items",)

MARKS = f"struct<{T.MARKERS.replace(' string', ':string').replace(' date', ':date')}>"
DECISION = (
    "array<struct<fetched_at:string,has_changes:boolean,complete:boolean,reason:string,voucher_sync_mode:string,"
    "from_date:date,to_date:date," + ",".join(f"{f}:boolean" for f in dict.fromkeys(FLAGS.values())) + ">>"
)


#: Bytes of the row groups that texts are written in, as packed; XML packs to a tenth or less.
TEXT_GROUP = 2 << 20
#: What is written for a while only is packed tightly.
PACKED = "zstd"


def together(writes: list[Callable[[], None]]) -> None:
    """Run independent writes as concurrent Spark jobs; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=8) as pool:
        for done in [pool.submit(w) for w in writes]:
            done.result()


@dataclass(frozen=True)
class Landed:
    """A file too large for one row."""

    company_id: str
    section: str
    fetched_at: str
    path: str


class Staged:
    """Rows of every section of a batch, parsed once and kept in the batch's own folder until it is committed.

    The decoded texts are written by section first, so that each landed file is read a single time.
    """

    def __init__(self, store: LedgerStore, responses: DataFrame, batch_id: int, large: list[Landed]):
        self.store, self.spark = store, store.spark
        self.name = f"batch_id={batch_id}"
        self.folder = f"{store.root}/_staged/{self.name}"
        texts = R.prepare(responses).withColumn("of_section", F.col("section"))
        # Small row groups, as a reader's batch holds up to 4096 texts of a group at once.
        writer = texts.write.mode("overwrite").partitionBy("of_section").option("parquet.block.size", TEXT_GROUP)
        writer.option("compression", PACKED).parquet(f"{self.folder}/texts")
        self.texts = self.spark.read.schema(texts.schema).parquet(f"{self.folder}/texts")
        self.large: dict[str, list[Landed]] = {}
        for file in large:
            self.large.setdefault(file.section, []).append(file)
        # Bounded by the sections defined, however many rows there are.
        known = self.texts.filter(F.col("of_section").isin(*D.SECTIONS)).select("of_section").distinct()
        self.present = {row["of_section"] for row in known.collect()} | (self.large.keys() & D.SECTIONS.keys())
        self._schemas: dict = {}
        together([lambda n=name: self._stage(n) for name in sorted(self.present)])

    def _stage(self, name: str) -> None:
        checked = self.texts.filter(F.col("of_section") == name).drop("of_section")
        rows = staged_rows(parse_documents(checked, D.SECTIONS[name]), D.SECTIONS[name])
        rows = rows.withColumn("pos", F.col("pos").cast("long")).withColumn("line", F.lit(None).cast("long"))
        for found in self._large(name):
            rows = rows.unionByName(found, allowMissingColumns=True)
        self._schemas[name] = rows.schema
        rows.write.mode("overwrite").option("compression", PACKED).parquet(f"{self.folder}/{name}")

    def _large(self, name: str) -> list[DataFrame]:
        """Rows of the section's large files, by charset."""
        files = self.large.get(name, [])
        tag = L.row_tag(D.SECTIONS[name])
        if files and tag is None:
            raise ValueError(f"exports of {name} have to fit one row each")
        places = self.spark.createDataFrame(
            [(x.company_id, x.section, x.fetched_at, x.path) for x in files],
            "company_id string, section string, fetched_at string, path string",
        )
        by_charset: dict[str, list[str]] = {}
        for file in files:
            by_charset.setdefault(L.charset_of(self.spark, file.path), []).append(file.path)
        found = [
            L.staged_large(L.pieces(self.spark, paths, tag, charset), D.SECTIONS[name], tag)
            for charset, paths in by_charset.items()
        ]
        return [rows.join(F.broadcast(places), "path") for rows in found]

    def all(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._schemas[name]).parquet(f"{self.folder}/{name}")

    def rows(self, name: str) -> DataFrame:
        """Valid rows of a section that is present, of documents without an error."""
        rows = self.all(name)
        failed = rows.filter(F.col("error").isNotNull()).select("path").distinct()
        return rows.filter("valid").join(failed, "path", "left_anti").withColumn("origin", F.lit(name))

    def documents(self) -> DataFrame:
        """One row per document: its valid rows, whether any carries a value, and its error."""
        columns = ["company_id", "section", "fetched_at", "path"]
        found = self.spark.read.schema(self._unknown_schema).parquet(f"{self.folder}/unknown").select(
            *columns, F.lit(0).cast("long").alias("rows"), F.lit(False).alias("carries"), F.lit("Unknown section").alias("error")
        )
        for name in sorted(self.present):
            rows = self.all(name)
            carries = G.carries_value() if "closing_value" in rows.columns else F.lit(False)
            part = rows.withColumn("section", F.lit(name)).groupBy(*columns).agg(
                F.count_if("valid").alias("rows"),
                F.coalesce(F.bool_or(F.col("valid") & carries), F.lit(False)).alias("carries"),
                F.min("error").alias("error"),
            )
            found = found.unionByName(part)
        return found

    def drop_texts(self) -> None:
        """The texts go as soon as their rows are staged; of sections nobody defined the names stay."""
        unknown = D.unknown_sections(self.texts).select("company_id", "section", "fetched_at", "path")
        self._unknown_schema = unknown.schema
        unknown.write.mode("overwrite").parquet(f"{self.folder}/unknown")
        Folder(self.spark, self.folder).drop("texts")

    def drop(self) -> None:
        Folder(self.spark, f"{self.store.root}/_staged").drop(self.name)


def refresh(
    store: LedgerStore,
    responses: DataFrame,
    batch_id: int,
    synced_at: datetime,
    enabled: DataFrame | None = None,
    full_snapshot: bool = False,
    large: list[Landed] = (),
) -> None:
    """Merge one batch of landed responses. A committed batch is not run again, an uncommitted one starts over.

    A fetch (company, fetched_at) may come in any number of batches, cut anywhere and in any order. Rows are stored as they
    come, each with its fetch; which sections of which fetch count is decided anew for all fetches of the batch's companies
    that are not closed yet, from what has arrived of them so far: a fetch's markers are compared with those of the whole
    fetch before it, never with its own. A fetch is whole when every section that its plan asks for is there, with all
    documents that its ``manifest`` names (without a manifest, with at least one). Then it is logged as success and its
    markers are what later fetches are compared with; until then it is logged as incomplete. A replaced table moves on to
    the sections of a fetch that are whole. A fetch with a failed or cut-off document is hidden and logged as an error, one
    with unchanged markers is hidden and logged as skipped.

    Sections that the manifest marks as SNAPSHOT, or all of a whole fetch with ``full_snapshot``, list all rows there are:
    rows they do not list vanish (vouchers, those dated in the window that the plan asked for).

    ``large`` names files beyond one row; they are read in byte ranges. The commit comes last, then compaction if it is due.
    """
    if enabled is not None:
        responses = responses.join(enabled.select("company_id"), "company_id", "left_semi")
        names = {row["company_id"] for row in enabled.select("company_id").filter(F.col("company_id").isin([x.company_id for x in large])).collect()}
        large = [x for x in large if x.company_id in names]
    before = store.input_of(batch_id)
    if before is not None:
        if before in (_input(responses, large), ""):
            return
        raise ValueError(f"batch {batch_id} is committed with other input: a store goes with one checkpoint")
    with shuffles_freed(store.spark):
        _merged(store, responses, batch_id, synced_at, full_snapshot, list(large))


def _merged(
    store: LedgerStore, responses: DataFrame, batch_id: int, synced_at: datetime, full_snapshot: bool, large: list[Landed]
) -> None:
    staged = Staged(store, responses, batch_id, large)
    read = _input(staged.texts, large)  # a row per response; they are not read a second time
    staged.drop_texts()
    at = F.lit(synced_at).cast("timestamp")

    # Small tables first: what the decisions rest on.
    store.write("documents", staged.documents(), batch_id)
    here = store.committed("documents", batch_id).filter(F.col("batch_id") == batch_id)
    touched = here.groupBy("company_id").agg(F.max("fetched_at").alias("fetched_at"))
    small = []
    if "alter_ids" in staged.present:
        small.append(lambda: store.write("seen_markers", staged.rows("alter_ids"), batch_id))
    if "manifest" in staged.present:
        small.append(lambda: store.write("expected", staged.rows("manifest"), batch_id))
    stamp = touched.withColumn("last_synced_at", at)
    if "company_info" in staged.present:
        info = staged.rows("company_info").select("company_id", "name", *GUARDED, "fetched_at", "path", "pos")
        stamp = stamp.unionByName(info, allowMissingColumns=True)
    small.append(lambda: store.write("companies", stamp, batch_id))
    together(small)

    decisions = f"{staged.folder}/decisions"
    decide_fetches(store, batch_id, touched, at).write.mode("overwrite").parquet(decisions)
    decided = store.spark.read.parquet(decisions)
    writes = [
        lambda: store.write("fetches", decided.select("company_id", "decision.*", "markers", "failed"), batch_id),
        lambda: store.write("sections", decided_sections(decided, full_snapshot), batch_id),
    ]
    for table, (names, _) in SOURCES.items():
        parts = [staged.rows(n) for n in names if n in staged.present]
        if parts:
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("synced_at", at)
            writes.append(lambda t=table, r=rows: store.write(t, r, batch_id))
    together(writes)

    fetches = store.committed("fetches", batch_id).filter(F.col("batch_id") == batch_id)
    moved = fetches.filter("complete AND has_changes AND markers IS NOT NULL")
    markers = moved.groupBy("company_id").agg(F.max_by(F.struct("fetched_at", "markers"), "fetched_at").alias("m"))
    together(
        [
            lambda: store.write("change_markers", markers.select("company_id", "m.fetched_at", "m.markers.*"), batch_id),
            lambda: store.write("sync_log", _log(store, batch_id, here, touched, fetches).withColumn("synced_at", at), batch_id),
        ]
    )
    sections = store.committed("sections", batch_id).filter(F.col("batch_id") == batch_id)
    told = sections.agg(F.count_if(~F.col("asked")).alias("hidden"), F.count_if("snapshot").alias("snapshots")).first()
    store.commit(batch_id, synced_at, read, told["hidden"] > 0, told["snapshots"] > 0)
    store.compact()
    staged.drop()


def _input(responses: DataFrame, large: list[Landed]) -> str:
    """What a batch is read from: the number of its responses, a digest of their paths, its large files."""
    marks = responses.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path")).alias("paths")).first()
    return f"{marks['n']} responses, {marks['paths']}" + "".join(f", {x.path}" for x in sorted(large, key=lambda x: x.path))


def _counted(pairs: Column) -> Column:
    """Entries (key, value) as a map."""
    return F.map_from_entries(pairs)


def _enough(documents: Column, expected: Column, section: str | Column) -> Column:
    """Whether a section is there: as many documents as the manifest names, or one."""
    key = F.lit(section) if isinstance(section, str) else section
    there = F.coalesce(F.try_element_at(documents, key), F.lit(0))
    return there >= F.coalesce(F.try_element_at(expected, key), F.lit(1))


def decide_fetches(store: LedgerStore, batch_id: int, touched: DataFrame, at: Column) -> DataFrame:
    """Per open fetch of the touched companies (company_id, fetched_at, markers, failed, there, expected, decision).

    Each company's fetches are folded in order: a fetch is compared with the markers of the last whole one before it.
    """
    closed = store.closed().withColumnRenamed("fetched_at", "close")

    def open_rows(table: str) -> DataFrame:
        rows = store.standing(table, batch_id).join(touched.select("company_id"), "company_id", "left_semi")
        return rows.join(closed, "company_id", "left").filter(F.col("close").isNull() | (F.col("fetched_at") > F.col("close")))

    fetch = ["company_id", "fetched_at"]
    last = F.max_by(F.struct("error", "rows", "carries"), "batch_id").alias("last")
    documents = open_rows("documents").groupBy(*fetch, "section", "path").agg(last)
    by_section = documents.groupBy(*fetch, "section").agg(
        F.count_if(F.col("last.error").isNull()).alias("documents"),
        F.coalesce(F.sum(F.when(F.col("last.error").isNull(), F.col("last.rows"))), F.lit(0)).alias("rows"),
        F.bool_or(F.col("last.error").isNull() & F.col("last.carries")).alias("carries"),
        F.min("last.error").alias("error"),
    )
    # At most one entry per section.
    fetches = by_section.groupBy(*fetch).agg(
        F.min("error").alias("failed"), F.sort_array(F.collect_list(F.struct("section", "documents", "rows", "carries"))).alias("there")
    )
    marked = open_rows("seen_markers").groupBy(*fetch).agg(
        F.max_by(F.struct(*C.MARKERS), F.struct("path", "pos", "batch_id")).alias("markers")
    )
    listed = open_rows("expected").groupBy(*fetch, "listed").agg(
        F.max("documents").alias("documents"), F.bool_or("snapshot").alias("snapshot")
    )
    expected = listed.groupBy(*fetch).agg(F.sort_array(F.collect_list(F.struct("listed", "documents", "snapshot"))).alias("expected"))
    fetches = fetches.join(marked, fetch, "left").join(expected, fetch, "left")

    baseline = store.standing("fetches").join(store.closed(), fetch, "left_semi")
    baseline = baseline.groupBy("company_id").agg(F.max_by("markers", "batch_id").alias("baseline"))
    years = G.newest_values(store.standing("companies", batch_id), ["company_id"], ["books_from", "books_to"])
    known = F.col("books_from").isNotNull() & F.col("books_to").isNotNull()
    today = F.to_date(at)
    bounds = years.select(
        "company_id",
        F.when(known, F.col("books_from")).otherwise(S.fiscal_year_start(today)).alias("fy_from"),
        F.when(known, F.col("books_to")).otherwise(today).alias("fy_to"),
    )
    columns = ["fetched_at", "markers", "failed", "there", "expected"]
    # As many entries as a company has had fetches since the last compaction.
    by_company = fetches.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("fetches"))
    by_company = by_company.join(baseline, "company_id", "left").join(bounds, "company_id", "left")

    def step(state: Column, one: Column) -> Column:
        plan = C.decide(one["markers"], state["cached"], F.col("fy_from"), F.col("fy_to"))
        count = _counted(F.transform(one["there"], lambda s: F.struct(s["section"], s["documents"])))
        asked = _counted(F.transform(one["expected"], lambda s: F.struct(s["listed"], s["documents"])))
        complete = one["failed"].isNull()
        complete = complete & F.coalesce(F.forall(one["expected"], lambda s: _enough(count, asked, s["listed"])), F.lit(True))
        for table, (names, flag) in SOURCES.items():
            there = [_enough(count, asked, n) for n in names]
            complete = complete & (~plan[flag] | reduce(lambda a, b: (a | b) if table in EITHER else (a & b), there))
        moved = complete & plan["has_changes"] & one["markers"].isNotNull()
        decision = F.struct(
            one["fetched_at"].alias("fetched_at"),
            plan["has_changes"].alias("has_changes"),
            complete.alias("complete"),
            plan["reason"].alias("reason"),
            plan["voucher_sync_mode"].alias("voucher_sync_mode"),
            plan["voucher_from_date"].alias("from_date"),
            plan["voucher_to_date"].alias("to_date"),
            *(plan[f].alias(f) for f in dict.fromkeys(FLAGS.values())),
        )
        return F.struct(
            F.when(moved, one["markers"]).otherwise(state["cached"]).cast(MARKS).alias("cached"),
            F.concat(state["decisions"], F.array(decision)).cast(DECISION).alias("decisions"),
        )

    start = F.struct(F.col("baseline").cast(MARKS).alias("cached"), F.array().cast(DECISION).alias("decisions"))
    folded = by_company.withColumn("folded", F.aggregate("fetches", start, step))
    pairs = F.arrays_zip(F.col("fetches"), F.col("folded.decisions").alias("decisions"))
    one = folded.select("company_id", F.explode(pairs).alias("one"))
    return one.select("company_id", "one.fetches.*", F.col("one.decisions").alias("decision"))


def decided_sections(decided: DataFrame, full_snapshot: bool) -> DataFrame:
    """What the sections of the decided fetches count for."""
    flag = reduce(
        lambda found, name: found.when(F.col("origin").isin(*SOURCES[name][0]), F.col(f"decision.{SOURCES[name][1]}")),
        SOURCES,
        F.when(F.lit(False), F.lit(False)),
    )
    expected = _counted(F.transform("expected", lambda s: F.struct(s["listed"], s["documents"])))
    whole = F.col("documents") >= F.coalesce(F.try_element_at(expected, F.col("origin")), F.lit(1))
    listed_all = F.exists("expected", lambda s: (s["listed"] == F.col("origin")) & s["snapshot"])
    # The summary of the stock counts where there is one and no item of the list carries a value.
    dense = F.exists("there", lambda s: (s["section"] == "stock_items") & s["carries"])
    summary = F.exists("there", lambda s: (s["section"] == "stock_summary") & (s["rows"] > 0))
    instead = F.when(F.col("origin") == "stock_items", dense | ~summary).when(F.col("origin") == "stock_summary", ~dense)
    rows = decided.select("*", F.explode("there").alias("one")).select(
        "*", F.col("one.section").alias("origin"), F.col("one.documents").alias("documents"), F.col("one.rows").alias("rows")
    )
    return rows.filter(F.col("origin").isin(*(n for names, _ in SOURCES.values() for n in names))).select(
        "company_id",
        "origin",
        "fetched_at",
        (F.col("failed").isNull() & flag & F.coalesce(instead, F.lit(True))).alias("asked"),
        whole.alias("whole"),
        (F.col("decision.complete") & (F.lit(full_snapshot) | F.coalesce(listed_all, F.lit(False)))).alias("snapshot"),
        "rows",
        F.when(F.col("origin") == "vouchers", F.col("decision.from_date")).alias("from_date"),
        F.when(F.col("origin") == "vouchers", F.col("decision.to_date")).alias("to_date"),
    )


def _log(store: LedgerStore, batch_id: int, here: DataFrame, touched: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row per company of the batch: the outcome of its newest fetch, and the rows of the sections that count."""
    table = reduce(lambda found, t: found.when(F.col("section").isin(*SOURCES[t][0]), F.lit(t)), SOURCES, F.when(F.lit(False), ""))
    sections = store.committed("sections", batch_id).filter(F.col("batch_id") == batch_id)
    asked = sections.filter("asked").select("company_id", F.col("origin").alias("section"), "fetched_at")
    counts = (
        here.filter(F.col("error").isNull())
        .join(asked, ["company_id", "section", "fetched_at"], "left_semi")
        .groupBy("company_id", table.alias("table"))
        .agg(F.sum("rows").alias("n"))
        .groupBy("company_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("table", "n")))).alias("records_synced"))
    )
    status = (
        F.when(F.col("failed").isNotNull(), "error")
        .when(~F.col("has_changes"), "skipped")
        .when(F.col("complete") | F.col("complete").isNull(), "success")  # of a closed fetch there is no decision
        .otherwise("incomplete")
    )
    outcome = touched.join(fetches.drop("batch_id"), ["company_id", "fetched_at"], "left")
    return outcome.join(counts, "company_id", "left").select(
        "company_id", "fetched_at", status.alias("status"), F.col("failed").alias("error_message"), "records_synced"
    )


def log_for_status(store: LedgerStore) -> DataFrame:
    """The sync log in the form ``changes.latest_status`` takes."""
    return store.read("sync_log").withColumnRenamed("records_synced", "records").withColumnRenamed("batch_id", "seq")


def status(store: LedgerStore) -> DataFrame:
    return C.latest_status(log_for_status(store))
