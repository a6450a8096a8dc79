"""Request captures: split raw byte blobs into request envelopes and profile them.

Bytes are viewed as Latin-1, one character per byte, so that markers can be found with string functions; only
the cut-out body is then decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saldo.sources.responses import LE_RUN

# Request line, end of the header block, envelope marks, all as single bytes or UTF-16LE pairs.
REQUEST_LINE = "POST / HTTP/1.1"
HEADER_END = "\r\n\r\n"


def _wide(text: str) -> str:
    return "".join(c + "\x00" for c in text)


def read_captures(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").load(root).select("path", "content")


def _body_text(body: Column) -> Column:
    """Envelope text of a request body; bytes after the closing tag (packet remains) are cut."""

    def span(opening: str, closing: str) -> Column:
        """From the first opening mark to the end of the last closing mark, or of the body if there is none."""
        start = F.instr(body, opening)
        from_last = F.substring_index(body, closing, -1)
        closed = F.contains(body, F.lit(closing))
        end = F.when(closed, F.length(body) - F.length(from_last)).otherwise(F.length(body))
        return F.when(start > 0, F.substring(body, start, end - start + 1))

    wide = span(_wide("<ENVELOPE>"), _wide("</ENVELOPE>"))
    wide = F.when(F.regexp_replace(wide, LE_RUN, "") == "", wide)
    narrow = span("<ENVELOPE>", "</ENVELOPE>")
    return F.coalesce(
        F.decode(F.encode(wide, "ISO-8859-1"), "UTF-16LE"),
        F.make_valid_utf8(F.encode(narrow, "ISO-8859-1").cast("string")),
    )


def extract_envelopes(blobs: DataFrame) -> DataFrame:
    """One row per request with an envelope, numbered in order of appearance within its blob."""
    carried = [c for c in blobs.columns if c != "content"]
    # The text before the first request line is no request.
    chunks = F.split(F.decode("content", "ISO-8859-1"), REQUEST_LINE)
    bodies = F.transform(
        F.filter(chunks, lambda c, i: (i > 0) & F.contains(c, F.lit(HEADER_END))),
        lambda c: F.substring(c, F.instr(c, HEADER_END) + 4, F.length(c)),
    )
    texts = F.transform(bodies, lambda b: F.trim(F.replace(_body_text(b), F.lit("\x00"), F.lit(""))))
    found = F.filter(texts, lambda t: t.isNotNull())
    return blobs.select(*carried, F.posexplode(found).alias("pos", "envelope")).select(
        *carried, (F.col("pos") + 1).alias("seq"), "envelope"
    )


def describe_requests(envelopes: DataFrame) -> DataFrame:
    """Kind, id, object type, fetched and computed names, period and company of each request."""

    def tag(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("envelope", rf"<{name}(?: [^>]*)?>([^<]*)</{name}>", 1)), F.lit(""))

    def listed(column: Column) -> Column:
        parts = F.transform(F.split(column, ","), lambda p: F.trim(p))
        return F.coalesce(F.filter(parts, lambda p: p != ""), F.array())

    collection = F.regexp_extract("envelope", r"(?s)<COLLECTION[ >].*?<TYPE>([^<]*)</TYPE>", 1)
    computed = F.regexp_extract_all("envelope", F.lit(r"<COMPUTE>([^<]*)</COMPUTE>"), F.lit(1))
    return envelopes.select(
        *envelopes.columns,
        tag("TYPE").alias("type"),
        tag("ID").alias("id"),
        F.nullif(F.trim(collection), F.lit("")).alias("object_type"),
        listed(tag("FETCH")).alias("fetch"),
        F.transform(computed, lambda c: F.trim(c)).alias("compute"),
        tag("SVFROMDATE").alias("from_date"),
        tag("SVTODATE").alias("to_date"),
        tag("SVCURRENTCOMPANY").alias("company"),
    )


def request_profile(requests: DataFrame) -> DataFrame:
    return requests.groupBy("type", "id").agg(F.count(F.lit(1)).alias("requests"))
