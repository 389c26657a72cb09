"""Filters of one column: O-20 to O-25."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_text, constant, dtype, quoted, size_of, unicode, words_of

COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
MANY = 400  # values from which a list is joined, not listed


def listed(value) -> list:
    """A list as it is, text as its pieces between commas."""
    return [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value) if isinstance(value, (list, tuple, set)) else [value]


def predicate(df: DataFrame, column: str, operator: str, value=None) -> Column:
    """One filter as a boolean Column; null where the column is null, so such rows drop."""
    dt = dtype(df, column)
    c = quoted(column)
    if operator in COMPARE:
        return COMPARE[operator](c, constant(value, dt))
    if operator in ("is_null", "is_not_null"):
        return c.isNull() if operator == "is_null" else c.isNotNull()
    if operator in ("in", "not_in"):
        found = c.isin([constant(v, dt) for v in listed(value)])
        return found if operator == "in" else ~found
    measure, _, compare = operator.rpartition("_")
    if measure in ("length", "words") and compare in ("gt", "gte", "lt", "lte"):
        return COMPARE[compare]((size_of if measure == "length" else words_of)(c, dt), F.lit(int(float(value))))
    text = as_text(c, dt)
    if operator in ("contains", "not_contains"):
        found = text.contains(str(value))
        return found if operator == "contains" else ~found
    if operator == "startswith":
        return text.startswith(str(value))
    if operator == "endswith":
        return text.endswith(str(value))
    if operator == "regex":
        return text.rlike(unicode(str(value)))
    raise ValueError(f"unknown operator {operator!r}")


def apply_filters(df: DataFrame, filters: list[dict]) -> DataFrame:
    """All filters, each {column, operator, value}; a long list of values becomes a semi or anti join."""
    plain = []
    for f in filters:
        column, operator, value = f["column"], f["operator"], f.get("value")
        if operator in ("in", "not_in") and len(values := listed(value)) > MANY:
            dt = dtype(df, column)
            keys = df.sparkSession.createDataFrame([(v,) for v in values], "v string").select(F.col("v").try_cast(dt).alias("__in")).where("__in IS NOT NULL").distinct()
            joined = df.where(quoted(column).isNotNull())
            df = joined.join(keys, quoted(column) == F.col("__in"), "left_semi" if operator == "in" else "left_anti")
        else:
            plain.append(predicate(df, column, operator, value))
    return df.where(reduce(lambda a, b: a & b, plain)) if plain else df
