"""Grouping and lists: O-49 to O-51."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import dtype, kind, quoted
from .ranks import medians
from .rows import ORDER

AGGREGATES = ("count", "sum", "mean", "median", "min", "max", "n_unique", "first", "list")


def aggregate(df: DataFrame, agg: str, column: str | None, order_by: list[str]) -> Column:
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; known are {', '.join(AGGREGATES)}")
    if agg == "count":
        return F.count(F.lit(1))
    if not column:
        raise ValueError(f"{agg} needs a column")
    c, what = quoted(column), kind(dtype(df, column))
    order = F.struct(*[quoted(o) for o in order_by])
    if agg == "sum":
        return F.coalesce(F.try_sum(c), F.lit(0))
    if agg == "mean":
        return F.avg(c)
    if agg in ("min", "max"):
        held = F.nullif(c, F.lit(float("nan")).cast(dtype(df, column))) if what == "float" and dtype(df, column).typeName() in ("float", "double") else c
        return F.min(held) if agg == "min" else F.max(held)
    if agg == "n_unique":
        return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))
    if agg == "first":
        return F.min_by(F.struct(c.alias("v")), order)["v"]
    # The list of a group comes together in one row, as it must.
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v")))), lambda x: x["v"])


def group_aggregate(df: DataFrame, by: list[str], agg: str, column: str | None = None, new_column: str | None = None, order_by: list[str] = ORDER) -> DataFrame:
    """One row for each group; nulls are a group. ``first`` and ``list`` follow the order."""
    name = new_column or ("count" if agg == "count" else f"{column}_{agg}")
    if agg == "median" and column and kind(dtype(df, column)) in ("integer", "float"):
        groups = df.groupBy(*[quoted(c) for c in by]).agg(F.lit(1).alias("__one"))
        found = medians(df, list(by), column).select(*[quoted(c).alias(f"__by_{k}") for k, c in enumerate(by)], "median")
        same = reduce(lambda a, b: a & b, [quoted(c).eqNullSafe(F.col(f"__by_{k}")) for k, c in enumerate(by)], F.lit(True))
        return groups.join(found, same, "left").select(*[quoted(c) for c in by], F.col("median").alias(name))
    if agg == "median":
        raise ValueError(f"a median needs a column of numbers, not {column!r}")
    return df.groupBy(*[quoted(c) for c in by]).agg(aggregate(df, agg, column, list(order_by)).alias(name))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """value, count: most common first, then by value, null among them."""
    dtype(df, column)
    counted = df.groupBy(quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    return counted.limit(top) if top else counted


def explode_list(df: DataFrame, column: str) -> DataFrame:
    """A row for each item; null and empty lists give one row with null."""
    if kind(dtype(df, column)) != "list":
        raise ValueError(f"{column!r} is not a list")
    return df.select(*[F.explode_outer(quoted(c)).alias(c) if c == column else quoted(c) for c in df.columns])
