"""Landed responses: read, decode, clean and check raw envelopes, one row per response.

Landing layout: ``<root>/company=<id>/section=<name>/fetched_at=<stamp>/<file>``. A response has to fit one
row, so exports are landed in date windows; ``saldo.sources.large`` reads single files beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saldo.functions import scalars as S

# Markers of a usable document, control characters and references XML does not allow.
MARKERS = r"(?i)<ENVELOPE|<RESPONSE"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
DECIMAL_REFERENCE = r"&#0*(?:[0-8]|11|12|1[4-9]|2\d|3[01]);"
HEX_REFERENCE = r"&#[xX]0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]);"
# Bytes seen as Latin-1 characters of which none is half of a surrogate.
NO_SURROGATE = r"\A[\x00-\xD7\xE0-\xFF]*\z"
# What CONTROL and both references drop, in one pass: a "&" counts only with the rest of its reference. Characters are listed
# one by one, as a class without ranges is looked up in a table, character by character of all texts.
DROPPED = (
    "[" + "".join(f"\\x{c:02X}" for c in (*range(0x20), 0x7F) if c not in (0x09, 0x0A, 0x0D)) + r"&](?:(?<!&)|"
    r"#(?:0*(?:[0-8]|11|12|1[4-9]|2\d|3[01])|[xX]0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]));)"
)
STATUS = r"(?i)<STATUS>([^<]*)</STATUS>"
FAILED = "0"
STATUS_DATA = r"(?is)<DATA>(.*?)</DATA>"
LINE_ERROR = r"(?is)<LINEERROR>(.*?)</LINEERROR>"
# Closing tags of the two forms of report that are rare.
RARE_REPORT = r"(?i)</(?:LINEERROR|RESPONSE)>"
PLAIN_RESPONSE = r"(?is)^\s*(?:<\?xml[^>]*>\s*)?<RESPONSE>([^<]*)</RESPONSE>\s*$"

# A maximal run of well-formed UTF-16 code units, on bytes seen as Latin-1 characters.
LE_RUN = r"(?s)\G(?:(?:.[^\xD8-\xDF])++|(?:.[\xD8-\xDB].[\xDC-\xDF])++)"
BE_RUN = r"(?s)\G(?:(?:[^\xD8-\xDF].)++|(?:[\xD8-\xDB].[\xDC-\xDF].)++)"


def read_landing(spark: SparkSession, root: str) -> DataFrame:
    """Scan landed files; company, section and fetched_at come from the folder names."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "false")
        .load(root)
        .select(
            F.col("company").cast("string").alias("company_id"),
            "section",
            F.col("fetched_at").cast("string").alias("fetched_at"),
            "path",
            "content",
            F.lit(None).cast("string").alias("content_type"),
        )
    )


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is computed a single time.

    A filter on a plain projection is pushed below it with the whole expression copied in at every mention,
    so a chain of decode, clean, check and parse would run many times over. Nothing is pushed below a
    generator whose output it reads.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def _utf16(content: Column, charset: str) -> Column:
    """Text of well-formed UTF-16, else null (a strict ``decode`` would fail the job)."""
    latin, plain = F.decode(content, "ISO-8859-1"), content.cast("string")
    ascii_only = F.is_valid_utf8(plain) & (F.length(plain) == F.octet_length(content))
    run = LE_RUN if charset == "UTF-16LE" else BE_RUN
    # The quick tests first: bytes that are all ASCII hold no half of a surrogate.
    well_formed = F.when(ascii_only | latin.rlike(NO_SURROGATE), F.length(content) % 2 == 0).otherwise(
        F.regexp_replace(latin, run, "") == ""
    )
    return F.when(well_formed, F.decode(content, charset))


def decode_piece(content: Column, charset: str) -> Column:
    """Text of a piece of a file whose charset is known; bytes that are none are replaced, or leave no text in UTF-16."""
    if charset == "UTF-8":
        return F.make_valid_utf8(content.cast("string"))
    return _utf16(content, charset)


def _marked(name: str) -> Column:
    """Whether a text holds a marker of a usable document; the usual spelling is looked for without a pattern."""
    text = F.col(name)
    return text.contains("<ENVELOPE") | text.contains("<RESPONSE") | text.rlike(MARKERS)


def decode_responses(responses: DataFrame) -> DataFrame:
    """Bytes to text: UTF-16 when announced, marked or apparent, else the declared charset, else UTF-8."""
    kind = F.lit("")
    if "content_type" in responses.columns:
        kind = F.lower(F.coalesce("content_type", F.lit("")))
    content = F.col("content")
    start = F.hex(F.substring(content, 1, 2))
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    little, big = start == "FFFE", start == "FEFF"
    form = F.struct(
        big.alias("big"),
        (kind.contains("utf-16") | little | big | head.contains("\x00<") | head.contains("<\x00")).alias("wide"),
        F.when(little | big, F.substring(content, 3, 2147483647)).otherwise(content).alias("body"),
    )
    rows = once(responses, "__form", form)
    wide, big, body = F.col("__form.wide"), F.col("__form.big"), F.col("__form.body")

    # The byte order of the mark first, little end first without one, then the other.
    first = F.when(big, _utf16(body, "UTF-16BE")).otherwise(_utf16(body, "UTF-16LE"))
    second = F.when(big, _utf16(body, "UTF-16LE")).otherwise(_utf16(body, "UTF-16BE"))
    rows = once(rows, "__first", F.when(wide, first))
    usable_first = F.coalesce(_marked("__first"), F.lit(False))
    rows = once(rows, "__second", F.when(wide & ~usable_first, second))
    plain = F.when(kind.rlike(r"iso-8859-1|latin-?1"), F.decode(content, "ISO-8859-1")).otherwise(
        F.make_valid_utf8(content.cast("string"))
    )
    text = (
        F.when(usable_first, F.col("__first"))
        .when(_marked("__second"), F.col("__second"))
        .otherwise(plain)
    )
    return once(rows, "text", text).drop("content", "content_type", "__form", "__first", "__second")


def clean_text(text) -> Column:
    """Drop control characters and references to them; ``from_xml`` cuts a document short at either."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.regexp_replace(text, CONTROL, "")
    return F.regexp_replace(F.regexp_replace(text, DECIMAL_REFERENCE, ""), HEX_REFERENCE, "")


def clean_responses(responses: DataFrame) -> DataFrame:
    """``clean_text`` in one pass over the text.

    What that leaves differs only if dropping something has joined its neighbours to a reference; then a reference is left,
    and the steps are done one by one.
    """
    rows = once(responses, "__clean", F.regexp_replace("text", DROPPED, ""))
    clean = F.col("__clean")
    joined = clean.contains("&#") & clean.rlike(f"{DECIMAL_REFERENCE}|{HEX_REFERENCE}")
    return once(rows, "text", F.when(joined, clean_text("text")).otherwise(clean)).drop("__clean")


def response_error(text, rare: Column | None = None) -> Column:
    """Message of a response that reports failure; null for a usable one. ``rare`` says whether it holds RARE_REPORT."""
    text = F.col(text) if isinstance(text, str) else text
    rare = F.lit(True) if rare is None else rare

    def plain(found: Column) -> Column:
        message = S.unescape(F.trim(F.regexp_replace(F.trim(found), r"<[^>]+>", " ")))
        return F.coalesce(F.nullif(message, F.lit("")), F.lit("Unknown error"))

    return (
        F.when(text.isNull(), F.lit("No content"))
        .when(F.trim(F.regexp_extract(text, STATUS, 1)) == FAILED, plain(F.regexp_extract(text, STATUS_DATA, 1)))
        .when(rare & text.rlike(LINE_ERROR), plain(F.regexp_extract(text, LINE_ERROR, 1)))
        .when(rare & text.rlike(PLAIN_RESPONSE), plain(F.regexp_extract(text, PLAIN_RESPONSE, 1)))
    )


def check_responses(responses: DataFrame) -> DataFrame:
    """With ``error``; the rare reports of failure are searched for one by one only in texts that hold the closing tag of one."""
    rows = once(responses, "__rare", F.col("text").rlike(RARE_REPORT))
    return once(rows, "error", response_error("text", F.col("__rare"))).drop("__rare")


def usable(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNull()).drop("error")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("error").isNotNull())


def company_names(responses: DataFrame) -> DataFrame:
    """Names of the companies a response lists: of each COMPANY the attribute, else its NAME tags; order kept, no dedupe.

    The tags are cut apart at their opening brackets and read one by one.
    """
    cut = F.split("text", "<")
    tags = F.slice(cut, F.lit(2), F.size(cut))

    def named(found: Column) -> Column:
        return F.filter(F.transform(found, lambda n: F.trim(S.unescape(n))), lambda n: n != "")

    def opening(tag: Column, name: str) -> Column:
        return F.upper(F.regexp_extract(tag, r"^[^\s/>]*", 0)) == name

    companies = F.filter(tags, lambda tag: opening(tag, "COMPANY"))
    attributes = named(F.transform(companies, lambda tag: F.regexp_extract(F.substring_index(tag, ">", 1), r'(?i)\sNAME\s*=\s*"([^"]*)"', 1)))
    tagged = F.filter(tags, lambda tag: opening(tag, "NAME"))
    inner = named(F.transform(tagged, lambda tag: F.regexp_extract(tag, r"(?s)>(.*)", 1)))
    names = F.when(F.size(attributes) > 0, attributes).otherwise(inner)
    keep = [c for c in responses.columns if c != "text"]
    return responses.select(*keep, F.posexplode(names).alias("pos", "name"))


def prepare(responses: DataFrame) -> DataFrame:
    """Decode, clean and check in one pass."""
    return check_responses(clean_responses(decode_responses(responses)))
