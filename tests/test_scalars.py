from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saldo.functions import scalars as S
from saldo.functions.transforms import TRANSFORMS, transform_for


def run(spark, function, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


CASES = [
    (S.safe_float, {None: 0, "": 0, "  ": 0, "abc": 0, "-15 Nos": -15, "500.00/Nos": 500, "1,200.50": 1200.5,
                    "5,000.00 Cr": 5000, "5d": 0, "nan": 0, "inf": 0, "1_000": 1000, ".5": 0.5, "5.": 5, "1e3": 1000, "/5": 0, "\t7\n8": 7}),
    (S.abs_float, {"-3.5": 3.5, None: 0}),
    (S.safe_int, {" 29": 29, "45 Days": 45, "5.0": 0, "1,000": 0, None: 0, "-7": -7, "x": 0}),
    (S.int_of_float, {"12.7": 12, "": 0, "-3.9": -3}),
    (S.safe_str, {None: "", " a\t": "a"}),
    (S.quantity_value, {"-10 Nos": 10, "": 0, "BOX": 0, "2.5": 2.5}),
    (S.quantity_unit, {"10 Nos": "Nos", "NOS": "NOS", "10": "", "": "", None: ""}),
    (S.bool_yesno, {"Yes": True, "yes": True, "No": False, "": False, None: False}),
    (S.parse_date, {
        **dict.fromkeys(["20250401", "1-Apr-25", "1-APR-25", "1-apr-25", "1-Apr-2025", "01-04-2025", "1-4-2025"], date(2025, 4, 1)),
        "20250230": None, "x": None, None: None, "1-Apr-70": date(1970, 4, 1), "1-Apr-68": date(2068, 4, 1),
        "1-Apr-69": date(1969, 4, 1), "31-Feb-25": None, "2025-04-01": None, " 20250401 ": date(2025, 4, 1), "29-Feb-00": date(2000, 2, 29)}),
    (S.compact_to_date, {"20250401": date(2025, 4, 1), "2025-04-01": None, "20251301": None}),
    (S.iso_to_date, {"2025-04-01": date(2025, 4, 1), "20250401": None, "2025-02-30": None}),
    (S.iso_to_compact, {"2025-04-01": "20250401"}),
    (S.party_type, {"Sundry Debtors": "customer", "Sundry Creditors": "supplier"}),
    (S.dash_if_empty, {"": "—", None: "—", "a": "a"}),
]


@pytest.mark.parametrize("function,table", CASES, ids=[c[0].__name__ for c in CASES])
def test_text_functions(spark, function, table):
    assert run(spark, function, list(table)) == list(table.values())


def test_numbers_and_dates(spark):
    money = lambda *vs: [None if v is None else Decimal(v) for v in vs]
    assert run(spark, S.format_inr, money("0.4", "-999.5", "123456", "12345678", None, "99.49"), "decimal(18,2)") == [
        "₹0", "₹1,000", "₹1,23,456", "₹1,23,45,678", "₹0", "₹99",
    ]
    assert run(spark, S.aging_bucket, [30, 31, 61, 91, None], "int") == ["current", "31-60", "61-90", "over 90", "current"]
    assert run(spark, S.stock_status, money("1", "0", None), "decimal(18,4)") == ["In stock", "Out of stock", "Out of stock"]
    assert run(spark, S.pnl_label, money("0", "-1"), "decimal(18,2)") == ["Net Profit", "Net Loss"]
    days = [date(2025, 3, 31), date(2025, 4, 1), date(2024, 2, 29)]
    assert run(spark, S.fiscal_year_start, days, "date") == [date(2024, 4, 1), date(2025, 4, 1), date(2023, 4, 1)]
    assert run(spark, S.join_parts, [["a", None, " ", "b "], []], "array<string>") == ["a, b", ""]


def test_render_template(spark):
    df = spark.createDataFrame([("x {{ b }}", None)], "a string, b string")
    text = df.select(S.render_template("{{a}}-{{ b }}-{{ c }}!", {"a": "a", "b": "b"})).first()[0]
    assert text == "x {{ b }}--!"


def test_transform_names():
    assert set(TRANSFORMS) == {"string", "int", "float", "abs_float", "date", "quantity_value_abs", "quantity_unit", "bool_yesno"}
    with pytest.raises(ValueError):
        transform_for("upper")
