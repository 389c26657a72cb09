"""Tables put together and taken apart: O-41 to O-45, O-19."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_text, dtype, kind, quoted, unused

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti", "cross": "cross"}


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """The narrowest type that holds all; None if only text does."""
    types = [t for t in types if not isinstance(t, T.NullType)] or [T.NullType()]
    if all(t == types[0] for t in types):
        return types[0]
    kinds = {kind(t) for t in types}
    if kinds == {"integer"}:
        return T.LongType() if not any(isinstance(t, T.DecimalType) for t in types) else T.DecimalType(38, 0)
    if kinds <= {"integer", "float"}:
        return T.DoubleType()
    if kinds <= {"date", "datetime"}:
        return T.TimestampNTZType() if any(isinstance(t, T.TimestampNTZType) for t in types) else T.TimestampType()
    return None


def concat(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns by name, sorted, widened to a common type, null where a table has none."""
    if len(tables) < 2:
        raise ValueError("concat takes two tables or more")
    names = sorted({c for t in tables for c in t.columns})
    wide = {n: common_type([t.schema[n].dataType for t in tables if n in t.columns]) for n in names}

    def aligned(t: DataFrame) -> DataFrame:
        out = []
        for n in names:
            target = wide[n]
            if n not in t.columns:
                out.append(F.lit(None).cast(target or "string").alias(n))
            else:
                own = t.schema[n].dataType
                out.append((as_text(quoted(n), own) if target is None else quoted(n) if own == target else quoted(n).cast(target)).alias(n))
        return t.select(*out)

    return reduce(DataFrame.unionAll, [aligned(t) for t in tables])


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Joined on equal keys. The right side's names get ``_right`` where they clash; its keys go, but in a full join."""
    if how not in HOWS:
        raise ValueError(f"unknown join {how!r}")
    how, right_on = HOWS[how], right_on or left_on
    if how == "cross":
        names = {c: f"{c}_right" if c in left.columns else c for c in right.columns}
        return left.crossJoin(right.select(*[quoted(c).alias(n) for c, n in names.items()]))
    inner = right.select(*[quoted(c).alias(f"__r_{k}") for k, c in enumerate(right.columns)])
    at = {c: f"__r_{k}" for k, c in enumerate(right.columns)}
    on = reduce(lambda a, b: a & b, [quoted(a) == F.col(at[b]) for a, b in zip(left_on, right_on, strict=True)])
    joined = left.join(inner, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    out = []
    for c in left.columns:
        # A right join keeps the right side's key values under the left side's names.
        out.append(F.coalesce(quoted(c), F.col(at[right_on[left_on.index(c)]])).alias(c) if how == "right" and c in left_on else quoted(c))
    for c in right.columns:
        if c in right_on and how != "full":
            continue
        out.append(F.col(at[c]).alias(f"{c}_right" if c in left.columns else c))
    return joined.select(*out)


def merge(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer joins on shared keys, left to right; keys are one column, clashing names get ``_right``."""
    if len(tables) < 2:
        raise ValueError("merge takes two tables or more")

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        taken, names = set(a.columns), {}
        for c in b.columns:
            new = c
            while c not in on and new in taken:
                new += "_right"
            names[c] = new
            taken.add(new)
        return a.join(b.select(*[quoted(c).alias(n) for c, n in names.items()]), on, "full")

    return reduce(pair, tables)


def combine_and_save(combined: DataFrame, path: str, format: str = "parquet", overwrite: bool = False) -> dict:  # noqa: A002
    """Writes a concat, join or merge as a new table; says what was written."""
    from ..sources.sinks import save_as

    return save_as(combined, path, format, overwrite=overwrite)


def preview(combined: DataFrame, limit: int = 100) -> DataFrame:
    return combined.limit(limit)


def split_values(df: DataFrame, column: str) -> DataFrame:
    """value, part, rows: the parts that ``separate`` writes."""
    return df.groupBy(as_text(quoted(column), dtype(df, column)).alias("value")).agg(F.count(F.lit(1)).alias("rows")).select("value", part_name(F.col("value")).alias("part"), "rows")


def part_name(value):
    return F.regexp_replace(F.coalesce(value, F.lit("null")), r"[/\\]", "_")


def separate(df: DataFrame, column: str, path: str) -> DataFrame:
    """One folder ``part=<value>`` for each value; returns value, part, rows and path.

    Rows of a value go to one task, those of a frequent one to as many as it fills files, so that a value has no
    more files than its rows need. The folders' key has another name where the table has a column ``part``.
    """
    from ..sources.sinks import write

    key = unused("part", df.columns)
    write(df.withColumn(key, part_name(as_text(quoted(column), dtype(df, column)))), path, partition_by=[key])
    return split_values(df, column).withColumn("path", F.concat(F.lit(f"{path}/{key}="), "part"))
