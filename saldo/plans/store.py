"""Ledger tables on Parquet: a batch only adds files, and reading resolves them to the current state.

Layout: ``<root>/<table>/part=<part>/company_id=<c>/``, vouchers one level deeper by ``month``, tables of about one row per
company and batch without folders. A part is what one batch
wrote, or what the compaction of neighbouring parts left of them. ``<root>/_snapshots/<n>`` names the parts that count; it
is written last and under a name of its own, so all tables change together, a second writer fails, and an unfinished batch
is not seen. Reading opens just the listed parts. Parts that a compaction replaced are removed a few snapshots later.

Every row carries the fetch it is of, its document and its place there. Later fetches win, whatever the order of the
batches: upserted rows by key; children with their voucher (vouchers are stored with items and entries nested, so a
rewritten voucher replaces its children); of replaced tables, for each source section, the rows of its newest fetch that is
whole, which may have had none. Which sections of a fetch count is decided per fetch, not per batch (``saldo.plans.sync``):
rows of sections that were not asked for, or of a fetch with a failed document, stay hidden. Snapshots hide what they do not
list any more, and the removal of a company hides all of its rows up to a fetch.

Compaction is tiered: FAN parts of a tier become one of the next, so the number of live parts grows with the logarithm of
the number of batches. A merged part keeps of each key what may still be read: the newest row of closed fetches, and all
rows of fetches after the last whole one. What is hidden for good goes; markers of removal and of vanished rows go when the
oldest part is among those merged, as nothing is left below them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from saldo.files import Folder
from saldo.operators import merge as G
from saldo.operators.windows import latest_per_key
from saldo.schema import ITEM, LEDGER_ENTRY, TABLES, surrogate_id

GUARDED = ("books_from", "books_to", "gstin", "address")
NESTED = {
    "items": ITEM,
    "ledger_entries": LEDGER_ENTRY,
}
MARKERS = "alter_id string, alt_vch_id string, vch_id string, alt_mst_id string, last_voucher_date date"
ORIGIN = "origin string, fetched_at string, path string, pos long, line long, batch_id long"
INTERNAL = {
    # One row per landed document; an error keeps its rows out.
    "documents": "company_id string, section string, fetched_at string, path string, rows long, carries boolean, error string, batch_id long",
    "seen_markers": f"company_id string, {MARKERS}, fetched_at string, path string, pos long, batch_id long",
    "expected": "company_id string, listed string, documents long, snapshot boolean, fetched_at string, path string, batch_id long",
    # What was decided about a fetch and about its sections; the last batch that touched the fetch counts.
    "fetches": f"company_id string, fetched_at string, has_changes boolean, complete boolean, failed string, reason string, "
    f"voucher_sync_mode string, markers struct<{MARKERS.replace(' string', ':string').replace(' date', ':date')}>, batch_id long",
    "sections": "company_id string, origin string, fetched_at string, asked boolean, whole boolean, snapshot boolean, "
    "rows long, from_date date, to_date date, batch_id long",
    # Fetches up to this one are folded into the rows themselves.
    "closed": "company_id string, fetched_at string, batch_id long",
    "removals": "company_id string, fetched_at string, batch_id long",
}
REPLACED = tuple(t.name for t in TABLES.values() if t.rule == "replace")
#: Tables of about one row per company and batch, which lie in a part without folders per company.
PER_COMPANY = ("companies", "change_markers", "sync_log")
#: Sections whose rows make up a table, where they are not named alike.
ORIGINS = {"outstanding": ("outstanding_receivables", "outstanding_payables"), "stock_items": ("stock_items", "stock_summary")}
#: Parts of a tier that are merged into one.
FAN = 8
#: Snapshots for which replaced parts stay readable, and that are listed.
KEPT = 12


def _schema(table: str) -> StructType:
    if table in INTERNAL:
        return StructType.fromDDL(INTERNAL[table])
    schema = TABLES[table].schema
    if table == "vouchers":
        for name, columns in NESTED.items():
            schema = schema.add(name, ArrayType(StructType.fromDDL(columns)))
        schema = schema.add("month", "string")
    for f in StructType.fromDDL(ORIGIN):
        schema = schema.add(f)
    return schema


def own_columns(table: str) -> list[str]:
    """Columns of a stored table as read, without those that place a row."""
    internal = set(StructType.fromDDL(ORIGIN).fieldNames()) | {"month", *NESTED}
    return [c for c in _schema(table).fieldNames() if c not in internal]


@dataclass(frozen=True)
class Part:
    """What counts as one in reading; first and last: the snapshots that it stands for."""

    name: str
    first: int
    last: int
    tier: int
    tables: tuple[str, ...]
    #: Whether it may hold decisions that hide a section, and snapshots; where no part does, reading does not look for them.
    hides: bool = True
    lists: bool = True


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    parts: tuple[Part, ...] = ()
    #: What each batch was read from; batches below ``folded`` are in merged parts.
    batches: dict[str, str] = field(default_factory=dict)
    folded: int = 0
    #: Replaced parts and the snapshot that replaced them.
    retired: tuple[tuple[str, int], ...] = ()

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Snapshot:
        found = json.loads(text)
        parts = tuple(Part(**{**p, "tables": tuple(p["tables"])}) for p in found.pop("parts"))
        return cls(parts=parts, retired=tuple(map(tuple, found.pop("retired"))), **found)


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._snapshots = Folder(spark, f"{self.root}/_snapshots")
        self._written: dict[str, set[str]] = {}

    # ---- files ----

    def write(self, table: str, rows: DataFrame, batch_id: int) -> None:
        """The batch's rows of a table; the same batch again replaces them."""
        self._write(table, rows.withColumn("batch_id", F.lit(batch_id).cast("long")), f"b{batch_id}")

    def _write(self, table: str, rows: DataFrame, part: str) -> None:
        schema = _schema(table)
        if table == "vouchers":
            rows = rows.withColumn("month", F.date_format("date", "yyyy-MM"))
        shaped = rows.select(
            *(
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields
            )
        )
        folders = [c for c in ("company_id", "month") if c in schema.fieldNames()]
        if table in PER_COMPANY:  # a folder each would be a file per company, which may be many
            shaped.hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/{table}/part={part}")
        elif table in INTERNAL:  # a few rows per company and fetch
            shaped.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{table}/part={part}")
        else:
            # Few files per folder; a large company is split over several tasks.
            shaped = shaped.hint("rebalance", *(F.col(c) for c in folders))
            shaped.write.mode("overwrite").partitionBy(*folders).parquet(f"{self.root}/{table}/part={part}")
        self._written.setdefault(part, set()).add(table)

    def snapshot(self) -> Snapshot:
        names = [n for n in self._snapshots.names() if n.isdigit()]
        return Snapshot.of(self._snapshots.text(max(names))) if names else Snapshot()

    def commit(self, batch_id: int, committed_at=None, read: str = "", hides: bool = True, lists: bool = True) -> None:
        """Let what the batch wrote count from now on."""
        now = self.snapshot()
        name = f"b{batch_id}"
        tables = tuple(sorted(self._written.pop(name, ())))
        decides = "sections" in tables
        part = Part(name, now.number + 1, now.number + 1, 0, tables, hides and decides, lists and decides)
        batches = {**now.batches, str(batch_id): read}
        self._publish(Snapshot(now.number + 1, (*(p for p in now.parts if p.name != name), part), batches, now.folded, now.retired))

    def _publish(self, new: Snapshot) -> None:
        gone = [part for part, since in new.retired if since + KEPT <= new.number]
        new = Snapshot(new.number, new.parts, new.batches, new.folded, tuple(x for x in new.retired if x[0] not in gone))
        if not self._snapshots.put(f"{new.number:012}", new.text()):
            raise RuntimeError(f"another writer has published snapshot {new.number} of {self.root}")
        for part in gone:
            for table in (*TABLES, *INTERNAL):
                Folder(self.spark, f"{self.root}/{table}").drop(f"part={part}")
        for name in self._snapshots.names():
            if name.isdigit() and int(name) + KEPT < new.number:
                self._snapshots.drop(name)

    def input_of(self, batch_id: int) -> str | None:
        """What a committed batch was read from, empty if it is in a merged part; null if it was not committed."""
        now = self.snapshot()
        return now.batches.get(str(batch_id), "" if batch_id < now.folded else None)

    def rows_of(self, table: str, parts: list[str]) -> DataFrame:
        """All rows that the named parts hold of a table."""
        schema = _schema(table)
        if not parts:
            # Empty already for the planner, so that joins with it fall away; rows handed over by Python would start workers.
            return self.spark.range(1).filter(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        root = f"{self.root}/{table}"
        found = self.spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/part={p}" for p in parts))
        return found.select(*schema.fieldNames())

    def committed(self, table: str, batch_id: int | None = None) -> DataFrame:
        """All rows of the parts that count, and of one batch that is under way."""
        parts = [p.name for p in self.snapshot().parts if table in p.tables]
        if batch_id is not None and table in self._written.get(f"b{batch_id}", ()):
            parts = [p for p in parts if p != f"b{batch_id}"] + [f"b{batch_id}"]
        return self.rows_of(table, parts)

    # ---- current state ----

    def read(self, table: str) -> DataFrame:
        if table in ("voucher_items", "voucher_ledger_entries"):
            return self._children(table)
        if table == "companies":
            return G.newest_values(self.standing("companies"), ["company_id"], ["name", "last_synced_at", *GUARDED])
        if table == "sync_log":
            return self.standing("sync_log").select(*own_columns("sync_log"), "batch_id")
        rows = self.current(table)
        if table == "vouchers":
            rows = rows.withColumn("id", surrogate_id("company_id", "tally_guid"))
            return rows.select(*own_columns(table), "id")
        return rows.select(*own_columns(table)) if table in TABLES else rows

    def standing(self, table: str, batch_id: int | None = None) -> DataFrame:
        """Committed rows without those of removed companies."""
        rows, removed = self.committed(table, batch_id), self.committed("removals")
        return G.without_removed(rows, removed)

    def decided(self, batch_id: int | None = None) -> DataFrame:
        """What was decided last about each section of a fetch."""
        return latest_per_key(self.standing("sections", batch_id), ["company_id", "origin", "fetched_at"], [F.col("batch_id").desc()])

    def visible(self, table: str) -> DataFrame:
        """Rows of the sections that count, without those that a later snapshot does not list."""
        rows, parts = self.standing(table), self.snapshot().parts
        if any(p.hides for p in parts):
            rows = G.without_sections(rows, self._decided_of(table).filter("NOT asked"))
        if any(p.lists for p in parts):
            snapshots = self._decided_of(table).filter("asked AND whole AND snapshot")
            rows = G.without_vanished(rows, snapshots, "date" if table == "vouchers" else None)
        return rows

    def _decided_of(self, table: str) -> DataFrame:
        return self.decided().filter(F.col("origin").isin(*ORIGINS.get(table, (table,))))

    def current(self, table: str) -> DataFrame:
        """The state of a table, with the columns that place a row."""
        if table in REPLACED:
            return G.newest_sections(self.standing(table), self._decided_of(table).filter("asked AND whole"))
        if table in TABLES and TABLES[table].rule == "upsert":
            rows = self.standing(table) if table == "change_markers" else self.visible(table)
            return G.newest_rows(rows, list(TABLES[table].key))
        return self.standing(table)

    def _children(self, table: str) -> DataFrame:
        column = "items" if table == "voucher_items" else "ledger_entries"
        key = ["company_id", "tally_guid"]
        rows = self.visible("vouchers").select(*key, column, *G.VERSION)
        return G.newest_rows(rows, key).select(
            *key, surrogate_id(*key).alias("voucher_id"), F.posexplode(column).alias("line", "row")
        ).select(*key, "voucher_id", "line", "row.*")

    def vouchers_between(self, windows: DataFrame) -> DataFrame:
        """Current vouchers of the companies and days in ``windows`` (company_id, from_date, to_date; few rows).

        Whole rows are read of the windows' months only. Whether a voucher has moved out of its window since is seen from
        the keys and versions of the other months.
        """
        first_days = F.sequence(F.trunc("from_date", "month"), F.trunc("to_date", "month"), F.expr("INTERVAL 1 MONTH"))
        months = windows.select("company_id", F.explode(F.transform(first_days, lambda d: F.date_format(d, "yyyy-MM"))).alias("month"))
        months = months.distinct()
        rows = self.visible("vouchers")
        key = ["company_id", "tally_guid"]
        here = G.newest_rows(rows.join(F.broadcast(months), ["company_id", "month"], "left_semi"), key)
        elsewhere = (
            rows.select(*key, "month", F.struct(*G.VERSION).alias("then"))
            .join(F.broadcast(months), ["company_id", "month"], "left_anti")
            .groupBy(*key)
            .agg(F.max("then").alias("then"))
            .select(*(F.col(k).alias("e_" + k) for k in key), "then")
        )
        moved = (F.col("company_id") == F.col("e_company_id")) & (F.col("tally_guid") == F.col("e_tally_guid"))
        stays = here.join(elsewhere, moved & (F.col("then") > F.struct(*G.VERSION)), "left_anti")
        wanted = windows.select("company_id", "from_date", "to_date")
        return (
            stays.join(wanted, "company_id")
            .filter(F.col("date").between(F.col("from_date"), F.col("to_date")))
            .select(*own_columns("vouchers"))
        )

    # ---- removal and compaction ----

    def remove_companies(self, companies: DataFrame, fetched_at: str) -> None:
        """Hide all rows of the companies up to a fetch; a later fetch of one of them starts from nothing."""
        now = self.snapshot()
        name = f"r{now.number + 1}"
        rows = companies.select("company_id", F.lit(fetched_at).alias("fetched_at")).withColumn("batch_id", F.lit(None).cast("long"))
        self._write("removals", rows, name)
        part = Part(name, now.number + 1, now.number + 1, 0, tuple(self._written.pop(name)), False, False)
        self._publish(Snapshot(now.number + 1, (*now.parts, part), now.batches, now.folded, now.retired))

    def compact(self, everything: bool = False) -> int:
        """Merge the oldest FAN parts of every tier that has as many, or all parts into one; gives the number of merges."""
        merges = 0
        while True:
            now = self.snapshot()
            parts = sorted(now.parts, key=lambda p: p.first)
            if everything:
                chosen = parts if len(parts) > 1 else []
            else:
                tiers = sorted({p.tier for p in parts})
                chosen = next((c[:FAN] for t in tiers if len(c := [p for p in parts if p.tier == t]) >= FAN), [])
            if not chosen:
                return merges
            self._merge(now, chosen)
            merges += 1

    def _merge(self, now: Snapshot, chosen: list[Part]) -> None:
        name = f"c{chosen[0].first}-{now.number + 1}"
        oldest = min(now.parts, key=lambda p: p.first) in chosen
        for table in sorted({t for p in chosen for t in p.tables}):
            rows = self.rows_of(table, [p.name for p in chosen if table in p.tables])
            kept = self._kept(table, G.without_removed(rows, self.committed("removals")) if table != "removals" else rows, oldest)
            if kept is not None:
                self._write(table, kept, name)
        closing = self._newest_complete().withColumn("batch_id", F.lit(None).cast("long"))
        self._write("closed", closing, name)
        names = {p.name for p in chosen}
        tier, tables = max(p.tier for p in chosen) + 1, tuple(sorted(self._written.pop(name)))
        hides, lists = any(p.hides for p in chosen), any(p.lists for p in chosen)
        part = Part(name, chosen[0].first, chosen[-1].last, tier, tables, hides, lists)
        done = [int(n[1:]) for n in names if n.startswith("b")]
        batches = {b: read for b, read in now.batches.items() if int(b) not in done}
        self._publish(
            Snapshot(
                now.number + 1,
                (*(p for p in now.parts if p.name not in names), part),
                batches,
                max([now.folded, *(d + 1 for d in done)]),
                (*now.retired, *((n, now.number + 1) for n in sorted(names))),
            )
        )

    def _newest_complete(self) -> DataFrame:
        """Per company the last whole fetch, from which on everything is kept."""
        whole = latest_per_key(self.standing("fetches"), ["company_id", "fetched_at"], [F.col("batch_id").desc()])
        return whole.filter("complete").groupBy("company_id").agg(F.max("fetched_at").alias("fetched_at"))

    def closed(self) -> DataFrame:
        """Per company the fetch up to which compaction has folded the rows."""
        return self.committed("closed").groupBy("company_id").agg(F.max("fetched_at").alias("fetched_at"))

    def _kept(self, table: str, rows: DataFrame, oldest: bool) -> DataFrame | None:
        """What a merged part keeps of the rows of a table."""
        close = self._newest_complete().select("company_id", F.col("fetched_at").alias("close"))

        def with_close(df: DataFrame) -> tuple[DataFrame, Column]:
            joined = df.join(F.broadcast(close) if table in INTERNAL else close, "company_id", "left")
            return joined, F.coalesce(F.col("fetched_at") <= F.col("close"), F.lit(False))

        if table in ("removals", "closed"):
            return None if table == "closed" or oldest else rows
        if table == "sync_log":
            return rows
        if table in ("documents", "seen_markers", "expected"):
            joined, is_closed = with_close(rows)
            return joined.filter(~is_closed).drop("close")
        if table == "fetches":
            last = latest_per_key(rows, ["company_id", "fetched_at"], [F.col("batch_id").desc()])
            joined, is_closed = with_close(last)
            return joined.filter(~is_closed | (F.col("fetched_at") == F.col("close"))).drop("close")
        if table == "sections":
            last = latest_per_key(rows, ["company_id", "origin", "fetched_at"], [F.col("batch_id").desc()])
            joined, is_closed = with_close(last)
            newest = self.decided().filter("asked AND whole").groupBy("company_id", "origin").agg(F.max("fetched_at").alias("newest"))
            joined = joined.join(F.broadcast(newest), ["company_id", "origin"], "left")
            speaks = F.col("asked") & F.col("whole") & F.col("snapshot") & F.lit(not oldest)
            # A hidden section whose rows may lie in a part that is not among those merged stays hidden.
            hidden = ~F.col("asked") & F.lit(not oldest)
            keep = ~is_closed | (F.col("fetched_at") == F.col("newest")) | speaks | hidden
            return joined.filter(F.coalesce(keep, F.lit(False))).drop("close", "newest")
        if table == "companies":
            version = F.struct("fetched_at", "batch_id")
            columns = ["name", "last_synced_at", *GUARDED]
            best = rows.groupBy("company_id").agg(*(F.max(F.when(_filled(c), version)).alias("v_" + c) for c in columns))
            used = [version == F.col("v_" + c) for c in columns]
            keep = used[0]
            for x in used[1:]:
                keep = keep | F.coalesce(x, F.lit(False))
            return rows.join(best, "company_id").filter(keep).select(*rows.columns)
        if table == "change_markers":
            return G.newest_rows(rows, ["company_id"])
        decided = self._decided_of(table)
        joined, is_closed = with_close(rows)
        open_rows = joined.filter(~is_closed).drop("close")
        folded = G.without_sections(joined.filter(is_closed).drop("close"), decided.filter("NOT asked"))
        if table in REPLACED:
            folded = G.newest_sections(folded, decided.filter("asked AND whole"))
        else:
            folded = G.without_vanished(
                folded, decided.filter("asked AND whole AND snapshot"), "date" if table == "vouchers" else None
            )
            folded = G.newest_rows(folded, list(TABLES[table].key))
        return open_rows.unionByName(folded)


def _filled(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) != ""
