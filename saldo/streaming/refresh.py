"""The periodic refresh as a stream over the landing folder; each micro-batch is one batch of the store."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from saldo.plans.store import LedgerStore
from saldo.plans.sync import Landed, refresh
from saldo.sources import sections as D
from saldo.sources.large import row_tag

FILES = "path string, modificationTime timestamp, length long, content binary"
# Fixed value.
EVERY = "5 minutes"
#: Bytes from which on a file is read in ranges instead of as one row.
ROW_LIMIT = 64 << 20
#: Ending of files that are landed packed; they cannot be read in ranges, so each has to fit a row.
PACKED = ".gz"


def _placed(files: DataFrame, *more: str) -> DataFrame:
    """Files with what their folders say."""

    def part(name: str) -> Column:
        return F.regexp_extract("path", rf"/{name}=([^/]*)/", 1)

    return files.select(
        part("company").alias("company_id"), part("section").alias("section"), part("fetched_at").alias("fetched_at"), "path", *more
    )


def read_landing_stream(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of the landing folder with their sizes; their contents are not read here."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _placed(reader.load(landing), "length")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Landed files by name, one row per file, as they were before they were packed."""
    packed = [p for p in paths if p.endswith(PACKED)]
    plain = [p for p in paths if not p.endswith(PACKED)]
    if not packed and not plain:
        return _placed(spark.createDataFrame([], FILES), "content")
    found = [_placed(spark.read.format("binaryFile").load(plain), "content")] if plain else []
    if packed:
        # The text reader unpacks, and leaves the bytes as they are; its paths are those of addresses.
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        whole = spark.read.option("wholetext", "true").text(packed)
        found.append(_placed(whole.select(path.alias("path"), F.col("value").cast("binary").alias("content")), "content"))
    return reduce(DataFrame.unionByName, found)


def start_refresh(
    spark: SparkSession,
    landing: str,
    store: LedgerStore,
    checkpoint: str,
    every: str | None = EVERY,
    enabled: DataFrame | None = None,
    files_per_batch: int | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    full_snapshot: bool = False,
    row_limit: int = ROW_LIMIT,
) -> StreamingQuery:
    """Run on a timer, or with ``every=None`` once over all that has landed and stop.

    The stream replays a batch under the same number after a failure, and a batch only replaces its own
    folders, so every batch counts once. Back-dated vouchers read again within the overlap are upserts.
    The names of a batch's files pass the driver, where the file source keeps them anyway; files from ``row_limit``
    bytes on are read in ranges.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        files = batch.collect()
        large = [
            Landed(f["company_id"], f["section"], f["fetched_at"], f["path"])
            for f in files
            if f["length"] >= row_limit and not f["path"].endswith(PACKED) and f["section"] in D.SECTIONS and row_tag(D.SECTIONS[f["section"]])
        ]
        ranged = {x.path for x in large}
        responses = read_files(spark, [f["path"] for f in files if f["path"] not in ranged])
        refresh(store, responses, batch_id, clock(), enabled, full_snapshot, large)

    writer = (
        read_landing_stream(spark, landing, files_per_batch)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
