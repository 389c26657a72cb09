"""Values by their rank, of groups of any size: quantiles and medians without a group in one buffer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import quoted


def finite(c: Column) -> Column:
    """A number as double; NaN and infinities count as missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _range_key(value: str) -> Column:
    """A number that grows with the value and is the same for values close to each other: sign, and magnitude to 1/64."""
    v = F.col(value)
    size = F.floor(F.log2(F.abs(v)) * 64).cast("long") + 100_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))


def nearest(share: float) -> Callable[[Column], Column]:
    """The rank floor((n - 1) share + 1/2) of n values."""
    return lambda n: F.floor((n - 1) * share + 0.5).cast("long")


def ranked(counted: DataFrame, key: str, ranks: list[Callable[[Column], Column]]) -> DataFrame:
    """(key, q_0, q_1, ...): of each key the values at some ranks from 0, which may depend on the number of values.

    ``counted`` has each value (a double) of a key once, as value, and how often as many. A key's
    counted values are summed in ranges, and only the ranges that hold a rank are looked into.
    """
    counted = counted.select(key, "value", "many").withColumn("range", _range_key("value"))
    ranges = counted.groupBy(key, "range").agg(F.sum("many").alias("many"))
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.select(key, "range", (F.sum("many").over(before) - F.col("many")).alias("start"), F.sum("many").over(before).alias("end"), F.sum("many").over(Window.partitionBy(key)).alias("n"))
    places = F.array(*[F.struct(rank(F.col("n")).alias("rank"), F.lit(k).alias("k")) for k, rank in enumerate(ranks)])
    wanted = ranges.select(key, "range", "start", F.filter(places, lambda x: (x["rank"] >= F.col("start")) & (x["rank"] < F.col("end"))).alias("w")).where(F.size("w") > 0)
    inside = Window.partitionBy(key, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(wanted, [key, "range"]).withColumn("upto", F.col("start") + F.sum("many").over(inside))
    hit = placed.select(key, "value", F.explode(F.filter("w", lambda x: (x["rank"] < F.col("upto")) & (x["rank"] >= F.col("upto") - F.col("many")))).alias("w"))
    return hit.groupBy(key).agg(*[F.max(F.when(F.col("w.k") == k, F.col("value"))).alias(f"q_{k}") for k in range(len(ranks))])


MIDDLE = [lambda n: F.floor((n - 1) / 2).cast("long"), lambda n: F.ceil((n - 1) / 2).cast("long")]


def medians(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(the columns ``by``, median): the mean of the two middle values of each group with any; null is a group."""
    held = df.select(F.struct(F.lit(0).alias("__all"), *[quoted(c) for c in by]).alias("__key"), finite(quoted(column)).alias("value")).where("value IS NOT NULL")
    counted = held.groupBy("__key", "value").agg(F.count(F.lit(1)).alias("many"))
    found = ranked(counted, "__key", MIDDLE)
    return found.select(*[F.col("__key").getField(c).alias(c) for c in by], ((F.col("q_0") + F.col("q_1")) / 2).alias("median"))
