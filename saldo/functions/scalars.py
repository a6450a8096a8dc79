"""Value cleaning, dates and display helpers as Column expressions (no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed values.
BLANKS = " \t\n\r\f\x0b"
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
INTEGER = r"^[+-]?\d+(_\d+)*$"
#: The characters of a number's text: up to a blank or a slash. Listed one by one, they are looked up and not compared.
AMOUNT = r"^[ \t\n\x0B\f\r]*([^ \t\n\x0B\f\r/]*)"
#: The word after the first one, or the only word if it holds a letter.
UNIT = r"^\s*(?:\S+\s+(?=\S)|(?=\S*\p{L}))(\S+)"
DEBIT_VOUCHER_TYPES = ("Sales", "Receipt", "Debit Note")
DEBTOR_GROUP = "Sundry Debtors"
CREDITOR_GROUP = "Sundry Creditors"
# Two-digit years from here on belong to the 1900s.
YEAR_PIVOT = 69


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.trim(col(c), F.lit(BLANKS))


def safe_str(c) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def unescape(c) -> Column:
    """Predefined XML entities as characters."""
    text = col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def first_token(c) -> Column:
    return F.regexp_extract(col(c), r"^\s*(\S+)", 1)


def safe_float(c) -> Column:
    """Number at the head of a text such as ``1,200.50``, ``-15 Nos`` or ``500.00/Nos``; else 0."""
    token = F.replace(F.regexp_extract(col(c), AMOUNT, 1), F.lit(","), F.lit(""))
    return F.coalesce(_matched(token, NUMBER).try_cast("double"), F.lit(0.0))


def safe_int(c) -> Column:
    return F.coalesce(_matched(first_token(c), INTEGER).try_cast("bigint"), F.lit(0).cast("bigint"))


def _matched(token: Column, pattern: str) -> Column:
    """A token that is all of the pattern, without underscores, else empty; the token is computed once."""
    return F.replace(F.regexp_extract(token, pattern.removesuffix("$") + r"\z", 0), F.lit("_"), F.lit(""))


def abs_float(c) -> Column:
    return F.abs(safe_float(c))


def int_of_float(c) -> Column:
    """Whole part of a number text: ``12.7`` gives 12; null if that is no 32-bit number."""
    return safe_float(c).try_cast("int")


def parse_date(c) -> Column:
    """``yyyymmdd``, ``d-Mon-yy``, ``d-Mon-yyyy`` and ``d-m-yyyy``; anything else is null."""
    v = strip(c)
    yy = F.regexp_extract(v, r"(\d{2})$", 1)
    century = F.when(yy >= F.lit(str(YEAR_PIVOT)), F.lit("19")).otherwise(F.lit("20"))
    short = F.concat(F.regexp_extract(v, r"^(\d{1,2}-[A-Za-z]{3}-)", 1), century, yy)
    return (
        F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd"))
        .when(v.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$"), F.try_to_date(short, "d-MMM-yyyy"))
        .when(v.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.try_to_date(v, "d-MMM-yyyy"))
        .when(v.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), F.try_to_date(v, "d-M-yyyy"))
    )


def quantity_value(c) -> Column:
    return abs_float(c)


def quantity_unit(c) -> Column:
    """The word after the number, or the only word if it holds a letter."""
    return F.coalesce(F.regexp_extract(col(c), UNIT, 1), F.lit(""))


def bool_yesno(c) -> Column:
    return F.lower(safe_str(c)) == "yes"


def first_non_empty(*candidates) -> Column:
    """First candidate that is neither null nor blank; null when all are."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in candidates))


def default_if_empty(c, default) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def join_parts(c) -> Column:
    """One text out of a repeated tag: its non-blank parts joined by ``, ``."""
    parts = F.transform(col(c), strip)
    return F.coalesce(F.array_join(F.filter(parts, lambda p: p != ""), ", "), F.lit(""))


def iso_to_compact(c) -> Column:
    return F.date_format(F.try_to_date(col(c), "yyyy-MM-dd"), "yyyyMMdd")


def compact_to_date(c) -> Column:
    return F.when(col(c).rlike(r"^\d{8}$"), F.try_to_date(col(c), "yyyyMMdd"))


def iso_to_date(c) -> Column:
    return F.when(col(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(col(c), "yyyy-M-d"))


def fiscal_year_start(day) -> Column:
    """1 April on or before ``day``."""
    day = col(day)
    return F.make_date(F.year(F.add_months(day, -3)), F.lit(4), F.lit(1))


def render_template(template: str, values: dict) -> Column:
    """Fill ``{{ name }}`` marks from columns; a mark without a column becomes empty."""
    pieces, at = [], 0
    for mark in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        pieces.append(F.lit(template[at : mark.start()]))
        if mark.group(1) in values:
            pieces.append(F.coalesce(col(values[mark.group(1)]).cast("string"), F.lit("")))
        at = mark.end()
    return F.concat(*pieces, F.lit(template[at:]))


def party_type(group) -> Column:
    return F.when(col(group) == DEBTOR_GROUP, "customer").otherwise("supplier")


def signed_amount(voucher_type, amount, debit_types=DEBIT_VOUCHER_TYPES) -> Column:
    """Effect of a voucher on its party's balance; the sign map is a parameter."""
    size = F.abs(F.coalesce(col(amount), F.lit(0)))
    return F.when(col(voucher_type).isin(*debit_types), size).otherwise(-size)


def aging_bucket(days) -> Column:
    days = F.coalesce(col(days), F.lit(0))
    return F.when(days > 90, "over 90").when(days > 60, "61-90").when(days > 30, "31-60").otherwise("current")


def stock_status(quantity) -> Column:
    return F.when(F.coalesce(col(quantity), F.lit(0)) > 0, "In stock").otherwise("Out of stock")


def format_inr(amount) -> Column:
    """Whole rupees with Indian digit grouping; the sign is dropped."""
    whole = F.floor(F.abs(F.coalesce(col(amount), F.lit(0))) + F.lit(0.5).cast("decimal(2,1)"))
    return F.concat(F.lit("₹"), F.regexp_replace(whole.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,"))


def dash_if_empty(c) -> Column:
    return default_if_empty(col(c).cast("string"), "—")


def pnl_label(profit) -> Column:
    return F.when(col(profit) >= 0, "Net Profit").otherwise("Net Loss")
