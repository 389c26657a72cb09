"""Columns: choosing, naming, casting, filling, replacing: O-32 to O-40."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_text, coerced, dtype, kind, quoted, typed
from .ranks import medians

DTYPES = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}
# The text forms that a cast to date or datetime tries, in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss")
INLINE = 200  # entries up to which a mapping is written into the expression
BLOCK_ROWS = 100_000


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns])


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """All names at once, so that two can be swapped."""
    for c in mapping:
        dtype(df, c)
    return df.select(*[quoted(c).alias(mapping.get(c, c)) for c in df.columns])


def cast_to(c: Column, dt: T.DataType, target: str) -> Column:
    """A cast that gives null where the value can't be read."""
    if target not in DTYPES:
        raise ValueError(f"unknown type {target!r}; known are {', '.join(DTYPES)}")
    if target == "string":
        return as_text(c, dt)
    if target in ("date", "datetime") and isinstance(dt, T.StringType):
        formats = DATE_FORMATS + TIME_FORMATS if target == "date" else TIME_FORMATS + DATE_FORMATS
        tried = F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in formats])
        return tried.cast("date") if target == "date" else tried
    return c.try_cast(DTYPES[target])


def cast_column(df: DataFrame, column: str, dtype_name: str, new_column: str | None = None) -> DataFrame:
    return df.withColumn(new_column or column, cast_to(quoted(column), dtype(df, column), dtype_name))


def ordered_fill(df: DataFrame, column: str, forward: bool = True, order: str = "row_id", block_rows: int | None = None) -> DataFrame:
    """Each null takes the last value before it (or the next after it), by a numeric order.

    Blocks of the order are filled by themselves; what a block hands on is one row of a small table.
    Blocks grow with the root of the table, so that no task has many more rows than there are blocks.
    """
    c, at = quoted(column), quoted(order)
    if block_rows is None:
        block_rows = max(BLOCK_ROWS, math.isqrt(int(df.agg(F.max(at) - F.min(at)).first()[0] or 0)))
    rows = df.withColumn("__block", F.floor(at / block_rows).cast("long"))
    w = Window.partitionBy("__block").orderBy(at if forward else at.desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("__own", F.last(c, ignorenulls=True).over(w))
    pick = F.max_by if forward else F.min_by
    ends = rows.groupBy("__block").agg(pick(F.when(c.isNotNull(), c), F.when(c.isNotNull(), at)).alias("__end"))
    before = Window.orderBy(F.col("__block") if forward else F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__block", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    joined = filled.join(carried, "__block", "left")
    return joined.select(*[F.coalesce("__own", "__carried").alias(n) if n == column else quoted(n) for n in df.columns])


def fill_missing(df: DataFrame, column: str, strategy: str, value=None, order: str = "row_id", block_rows: int | None = None) -> DataFrame:
    """Nulls become a value, a neighbour, or a statistic of the column."""
    dt, c = dtype(df, column), quoted(column)
    if strategy in ("forward", "backward"):
        return ordered_fill(df, column, strategy == "forward", order, block_rows)
    if strategy in ("value", "zero"):
        return df.withColumn(column, F.coalesce(c, coerced(0 if strategy == "zero" else typed(value, dt), dt)))
    if strategy in ("mean", "median") and kind(dt) not in ("integer", "float"):
        raise ValueError(f"{strategy} needs a column of numbers, {column!r} is {kind(dt)}")
    if strategy == "median":
        middle = medians(df, [], column).select("median").scalar()
        return df.withColumn(column, F.coalesce(c, middle.cast(dt) if kind(dt) == "integer" else middle))
    stats = {"mean": F.avg(c), "min": F.min(c), "max": F.max(c), "mode": F.mode(c, deterministic=True)}
    if strategy not in stats:
        raise ValueError(f"unknown strategy {strategy!r}")
    fill = df.agg(stats[strategy].alias("__fill")).scalar()  # one value, planned as a subquery
    return df.withColumn(column, F.coalesce(c, fill.cast(dt) if strategy == "mean" and kind(dt) == "integer" else fill))


def replace_values(df: DataFrame, column: str, mapping: dict, new_column: str | None = None) -> DataFrame:
    """Exact values by a mapping, whose targets may be null; all others stay."""
    dt, c = dtype(df, column), quoted(column)
    name = new_column or column
    pairs = [(typed(a, dt), None if b is None else typed(b, dt)) for a, b in mapping.items()]
    if len(pairs) <= INLINE:
        out = None
        for a, b in pairs:
            out = F.when(c == F.lit(a), coerced(b, dt)) if out is None else out.when(c == F.lit(a), coerced(b, dt))
        return df.withColumn(name, c if out is None else out.otherwise(c))
    table = df.sparkSession.createDataFrame([(str(a), None if b is None else str(b)) for a, b in pairs], "a string, b string")
    table = table.select(F.col("a").cast(dt).alias("__from"), F.col("b").cast(dt).alias("__to"), F.lit(True).alias("__set")).dropDuplicates(["__from"])
    joined = df.join(table, c == F.col("__from"), "left").withColumn("__new", F.when(F.col("__set"), F.col("__to")).otherwise(c))
    if name in df.columns:
        return joined.select(*[F.col("__new").alias(n) if n == name else quoted(n) for n in df.columns])
    return joined.select(*[quoted(n) for n in df.columns], F.col("__new").alias(name))


def concat_columns(df: DataFrame, columns: list[str], new_column: str, separator: str = " ") -> DataFrame:
    """Columns as text, nulls as nothing, with a separator between all."""
    return df.withColumn(new_column, F.concat_ws(separator, *[F.coalesce(as_text(quoted(c), dtype(df, c)), F.lit("")) for c in columns]))


def unnest_struct(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct as columns at the end, prefixed by its name where a column has theirs."""
    dt = dtype(df, column)
    if not isinstance(dt, T.StructType):
        raise ValueError(f"{column!r} is {kind(dt)}, not a struct")
    others = [c for c in df.columns if c != column]
    fields = [quoted(column).getField(f.name).alias(f"{column}_{f.name}" if f.name in others else f.name) for f in dt.fields]
    return df.select(*[quoted(c) for c in others], *fields)


def extract_field(df: DataFrame, column: str, path: str, new_column: str) -> DataFrame:
    """A value in a struct or in JSON text, by a dotted path."""
    dt, c = dtype(df, column), quoted(column)
    if isinstance(dt, T.StructType):
        for name in path.split("."):
            c = c.getField(name)
        return df.withColumn(new_column, c)
    return df.withColumn(new_column, F.get_json_object(as_text(c, dt), "$." + path))


