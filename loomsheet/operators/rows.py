"""Row selection, order, sampling and paging: O-27 to O-31, O-48, O-52 to O-57."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..functions.values import as_text, constant, dtype, quoted
from .predicates import apply_filters, predicate

ORDER = ("row_id",)


def filter_rows(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    return apply_filters(df, [{"column": column, "operator": operator, "value": value}])


def filter_range(df: DataFrame, column: str, min=None, max=None) -> DataFrame:  # noqa: A002
    """Rows from min to max, both included; without a bound all rows."""
    dt, c = dtype(df, column), quoted(column)
    if min is not None:
        df = df.where(c >= constant(min, dt))
    if max is not None:
        df = df.where(c <= constant(max, dt))
    return df


def filter_keywords(df: DataFrame, column: str, keywords: list[str], case_sensitive: bool = False, exclude: bool = False) -> DataFrame:
    """Rows whose text has any keyword, or none; null text is in neither."""
    found = contains_any(as_text(quoted(column), dtype(df, column)), list(keywords), case_sensitive)
    return df.where(~found if exclude else found)


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without a null in the columns; NaN isn't null."""
    return df.where(reduce(lambda a, c: a & quoted(c).isNotNull(), columns or df.columns, F.lit(True)))


def flag_rows(df: DataFrame, column: str, operator: str, value=None, new_column: str = "flag") -> DataFrame:
    return df.withColumn(new_column, F.coalesce(predicate(df, column, operator, value), F.lit(False)))


def dedupe(df: DataFrame, columns: list[str] | None = None, order_by: list[str] = ORDER) -> DataFrame:
    """One row of each key, the first in order; all columns: one of each row."""
    if not columns:
        return df.dropDuplicates()
    first = F.min_by(F.struct(*[quoted(c) for c in df.columns]), F.struct(*[quoted(c) for c in order_by]))
    return df.groupBy(*[quoted(c) for c in columns]).agg(first.alias("__first")).select("__first.*")


def _order(columns, descending, tie):
    flags = descending if isinstance(descending, (list, tuple)) else [descending] * len(columns)
    keys = [quoted(c).desc_nulls_last() if d else quoted(c).asc_nulls_last() for c, d in zip(columns, flags, strict=True)]
    return keys + [quoted(c).asc_nulls_last() for c in tie if c not in columns]


def sort_rows(df: DataFrame, columns: list[str], descending=False, order_by: list[str] = ORDER) -> DataFrame:
    """Sorted with nulls last either way; ties keep the order."""
    return df.orderBy(*_order(columns, descending, [c for c in order_by if c in df.columns]))


def top_n(df: DataFrame, column: str, n: int = 10, descending: bool = True, order_by: list[str] = ORDER) -> DataFrame:
    return sort_rows(df, [column], descending, order_by).limit(n)


def limit_rows(df: DataFrame, n: int, order_by: list[str] = ORDER, dense: bool = False) -> DataFrame:
    """The first n rows in order; a dense row number from 0 is filtered instead of sorted."""
    if dense:
        return df.where(quoted(order_by[0]) < n)
    return df.orderBy(*[quoted(c).asc_nulls_last() for c in order_by]).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42, order_by: list[str] = ORDER) -> DataFrame:
    """Exactly min(n, rows) rows, the same for a seed: those with the smallest hashes of their order keys."""
    keys = [quoted(c) for c in order_by]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys).cast("binary")), *keys).limit(n)


def page(df: DataFrame, offset: int, limit: int, filters: list[dict] = (), sorts: list[dict] = (), order_by: list[str] = ORDER, dense: bool = False) -> DataFrame:
    """One page; sorts are {column, descending}. Without filters and sorts, a dense row number is a range."""
    if dense and not filters and not sorts:
        return df.where(quoted(order_by[0]).between(offset, offset + limit - 1))
    df = apply_filters(df, list(filters))
    return df.orderBy(*_order([s["column"] for s in sorts], [s.get("descending", False) for s in sorts], order_by)).offset(offset).limit(limit)


def page_total(df: DataFrame, filters: list[dict] = ()) -> int:
    return apply_filters(df, list(filters)).count()


def get_row(df: DataFrame, row_id: int, name: str = "row_id") -> DataFrame:
    return df.where(quoted(name) == row_id)
