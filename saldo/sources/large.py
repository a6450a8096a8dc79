"""Row-wise reading of exports too large for one row.

The text source splits files on any separator and hands out byte ranges, so using a row's closing tag as the line
separator spreads one file over many tasks; each piece then parses as a small envelope of its own. The separator is given in
the file's charset, so UTF-16 is split on whole characters; a piece's bytes are decoded afterwards.

A job over the text source reads all ranges of a file or fails. Whether the file itself is whole is seen from its pieces: one
must open the envelope and the piece behind the last row must close it; otherwise the document is an error as a whole, as
is one with a piece that does not parse, since a silently shorter section could delete data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from saldo.files import Folder
from saldo.sources.definitions import COLLECTION, Section, parse_documents, read_section, staged_rows
from saldo.sources.responses import clean_text, decode_piece

CUT_OFF = "Malformed document"


def row_tag(section: Section) -> str | None:
    """The tag of a section's rows where they lie directly in the collection; other sections are not split."""
    paths = [p for p in section.rows if p.startswith(f"{COLLECTION}/")]
    return paths[0].removeprefix(f"{COLLECTION}/") if section.mode == "list" and paths else None


def charset_of(spark: SparkSession, path: str) -> str:
    """UTF-16 by its mark or by the look of the first characters, else UTF-8."""
    folder, _, name = path.rpartition("/")
    head = Folder(spark, folder).head(name, 64)
    if head[:2] == b"\xfe\xff" or (head[:2] != b"\xff\xfe" and b"\x00<" in head and b"<\x00" not in head[:2]):
        return "UTF-16BE"
    return "UTF-16LE" if head[:2] == b"\xff\xfe" or b"<\x00" in head else "UTF-8"


def pieces(spark: SparkSession, paths: list[str], tag: str, charset: str) -> DataFrame:
    """(path, block, line, text) of what lies between closing tags; block is the start of the file range, line the order there."""
    found = spark.read.option("lineSep", f"</{tag}>").option("encoding", charset).text(paths)
    return found.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        decode_piece(F.col("value").cast("binary"), charset).alias("text"),
    )


def _envelopes(found: DataFrame, tag: str) -> DataFrame:
    """Pieces that end in a row, as an envelope of that row."""
    start = F.regexp_instr("text", F.lit(f"<{tag}[ >]"))
    row = F.substring(F.col("text"), start, F.length("text"))
    opening = "".join(f"<{t}>" for t in COLLECTION.split("/"))
    ending = "".join(f"</{t}>" for t in reversed(COLLECTION.split("/")))
    envelope = F.concat(F.lit(f"<ENVELOPE>{opening}"), clean_text(row), F.lit(f"</{tag}>{ending}</ENVELOPE>"))
    rows = found.filter((start > 0) & ~F.col("text").contains("</ENVELOPE>"))
    return rows.withColumn("text", envelope).withColumn("error", F.lit(None).cast("string"))


def cut_off(found: DataFrame) -> DataFrame:
    """(path, error) of the files whose envelope is not both opened and closed."""
    text = F.col("text")
    return (
        found.groupBy("path")
        .agg(F.count_if(text.rlike(r"(?i)<ENVELOPE")).alias("opened"), F.count_if(text.rlike(r"(?i)</ENVELOPE>\s*$")).alias("closed"))
        .filter("opened <> 1 OR closed <> 1")
        .select("path", F.lit(CUT_OFF).alias("error"))
    )


def staged_large(found: DataFrame, section: Section, tag: str) -> DataFrame:
    """Rows of a section as ``staged_rows`` gives them, placed by ``pos`` and ``line``.

    A file that is cut off leaves a row with the error, one without rows a row that is not valid.
    """
    rows = staged_rows(parse_documents(_envelopes(found, tag), section), section)
    rows = rows.drop("pos").withColumnRenamed("block", "pos")
    bad = cut_off(found)
    none = found.select("path").distinct().join(bad, "path", "left").withColumn("valid", F.lit(False))
    return rows.unionByName(none, allowMissingColumns=True)


def read_large_export(spark: SparkSession, path: str, section: Section, tag: str) -> DataFrame:
    """Rows of ``section`` from files whose rows are ``<tag ...> ... </tag>``; tags may not nest.

    Comes without a ``pos``; ``path`` and ``offset`` (start of the row's file range) place a row. A piece that
    does not parse is an error of the whole read.
    """
    found = pieces(spark, [path], tag, charset_of(spark, path))
    return read_section(_envelopes(found, tag).withColumnRenamed("block", "offset").drop("line"), section).drop("pos")
