"""The named transforms a section definition may use on the text of a tag."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from saldo.functions import scalars as S

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "string": S.safe_str,
    "int": S.safe_int,
    "float": S.safe_float,
    "abs_float": S.abs_float,
    "date": S.parse_date,
    "quantity_value_abs": S.quantity_value,
    "quantity_unit": S.quantity_unit,
    "bool_yesno": S.bool_yesno,
}
# These read a single value: a repeated tag is a list, and a list is not a number.
NUMERIC = ("int", "float", "abs_float")


def transform_for(name: str) -> Callable[[Column], Column]:
    if name not in TRANSFORMS:
        raise ValueError(f"no transform is called {name!r}")
    return TRANSFORMS[name]
