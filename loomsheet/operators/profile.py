"""Profiles of tables and columns: O-70 to O-79b."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import NESTED, as_text, dtype, kind, quoted
from ..sources.shared import has_shared, scratch
from .ranks import MIDDLE, finite, nearest, ranked

SAMPLE_ROWS = 100_000
TOP, BINS, DISTRIBUTION_BINS, SHOWN = 20, 20, 50, 200
FEW = 16  # columns up to which each pair is an expression of its own
BLOCK, LOST = 4096, 1e-12  # rows that are multiplied together; share of a sum of squares below which a spread is rounding


def _numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if kind(f.dataType) in ("integer", "float")]


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing_percent, duplicate_rows."""
    nulls = reduce(lambda a, c: a + F.count_if(quoted(c).isNull()), df.columns, F.lit(0))
    cells = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("missing"))
    distinct = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("different"))
    both = cells.crossJoin(F.broadcast(distinct))  # one row each
    total = F.col("rows") * len(df.columns)
    return both.select("rows", F.lit(len(df.columns)).alias("columns"), F.coalesce(F.try_divide(F.col("missing") * 100.0, total), F.lit(0.0)).alias("missing_percent"), (F.col("rows") - F.col("different")).alias("duplicate_rows"))


def columns_by_type(df: DataFrame) -> DataFrame:
    """type, columns."""
    counts: dict[str, int] = {}
    for f in df.schema:
        counts[kind(f.dataType)] = counts.get(kind(f.dataType), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "type string, columns int")


def systematic_sample(df: DataFrame, rows: int, order: str = "row_id", most: int = SAMPLE_ROWS) -> DataFrame:
    """Every k-th row by a dense number, k = ceil(rows / most)."""
    return df.where(quoted(order) % max(1, -(-rows // most)) == 0)


def _stacked(df: DataFrame, columns: list[str], value) -> DataFrame:
    """(column, value) rows of several columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


LONG_TEXT = 64  # bytes from which a text is told apart by its hash
SKETCH = 1024  # accuracy of the sketch of quantiles: ranks are right to about 0.3 %
POINTS = 512  # values of a sketch that a histogram is made of
ABOUT = 0.02  # relative standard deviation of counts of different values
PLACES = 256  # bins that values are counted in beside the sketch; the closest merge first, so counts are exact on both sides of a gap wider than this part of the spread
REACH = 0.01  # share of the spread that a quantile may lie from the mean of the bin that holds its rank
NOISE = 1e-12  # relative rounding of a bin's mean


def _counted(df: DataFrame) -> DataFrame:
    """column, key, value, many: each different value of each column once, numbers as value, others as key."""

    def one(f) -> Column:
        c, what = quoted(f.name), kind(f.dataType)
        number = c.cast("double") if what in ("integer", "float") else F.lit(None).cast("double")
        exact = what == "float" and f.dataType.typeName() in ("float", "double") or what == "integer" and f.dataType.typeName() != "long"
        text = F.lit(None).cast("string") if exact else as_text(c, f.dataType)
        key = F.when(F.octet_length(text) > LONG_TEXT, F.md5(text.cast("binary"))).otherwise(text)
        return F.when(c.isNotNull(), F.struct(F.lit(f.name).alias("column"), key.alias("key"), number.alias("value")))

    pairs = F.array_compact(F.array(*[one(f) for f in df.schema]))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.key", "p.value").agg(F.count(F.lit(1)).alias("many"))


def _once(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, where there is one, and read back: what several parts of a plan use is made once."""
    if not has_shared(df.sparkSession):
        return df
    path = scratch(df.sparkSession, "counted")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scalars(df: DataFrame, *further) -> DataFrame:
    """A row for each column, from one aggregate; ``further`` makes more fields of a column, its number (null for others) and how many of these there are."""
    out = []
    for f in df.schema:
        c, what = quoted(f.name), kind(f.dataType)
        number = finite(c) if what in ("integer", "float") else F.lit(None).cast("double")
        n = F.count(number)
        out.append(
            F.struct(
                F.lit(f.name).alias("column"), F.lit(what).alias("type"), F.count(F.lit(1)).alias("count"), F.count_if(c.isNull()).alias("nulls"),
                F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"), F.when(n == 1, 0.0).otherwise(F.stddev_samp(number)).alias("std"), n.alias("n"), *[made(f, number) for made in further],
            )
        )
    return df.agg(F.array(*out).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def _shown(whole: DataFrame) -> DataFrame:
    percent = lambda n: F.coalesce(F.try_divide(n * 100.0, F.col("count")), F.lit(0.0))
    return whole.select(
        "column", "type", "count", "nulls", percent(F.col("nulls")).alias("null_percent"), "unique", percent(F.col("unique")).alias("unique_percent"),
        "min", "max", "mean", "std", "median", "q1", "q3", "histogram",
    )


def profile(df: DataFrame, exact: bool = True, bins: int = BINS) -> DataFrame:
    """A row for each column: type, count, nulls, null_percent, unique, unique_percent, and of numbers
    min, max, mean, std (0 for one value), median, q1, q3 by nearest rank, and the counts of ``bins``
    equal widths from min to max (an array).

    Two passes: one aggregate of scalars, and one table of each column's different values with their
    counts, made once, from which the rest follows. With ``exact`` false one pass, whatever the
    values are: counts of different values, quantiles and histogram come from sketches that tasks merge.
    These quantiles are of about the right rank, and on the right side of each wide gap between values.
    """
    if not exact:
        return _sketched(df, bins)
    stats = _scalars(df)
    counted = _once(_counted(df))
    unique = counted.groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    finite_ones = counted.where(finite(F.col("value")).isNotNull()).groupBy("column", "value").agg(F.sum("many").alias("many"))
    ranks = ranked(finite_ones, "column", [*MIDDLE, nearest(0.25), nearest(0.75)])
    ranks = ranks.select("column", ((F.col("q_0") + F.col("q_1")) / 2).alias("median"), F.col("q_2").alias("q1"), F.col("q_3").alias("q3"))
    bounds = finite_ones.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    binned = finite_ones.join(F.broadcast(bounds), "column").groupBy("column", _bin(F.col("value"), bins).alias("bin")).agg(F.sum("many").alias("many"))
    held = binned.groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("bin", "many"))).alias("held"))  # ``bins`` entries at most
    bars = held.select("column", F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.coalesce(F.element_at("held", k), F.lit(0).cast("long"))).alias("histogram"))
    whole = stats
    for part in (unique, ranks, bars):  # a row for each column at most
        whole = whole.join(F.broadcast(part), "column", "left")
    return _shown(whole.withColumn("unique", F.coalesce("unique", F.lit(0).cast("long"))))


def _sketched(df: DataFrame, bins: int) -> DataFrame:
    """A profile in one aggregate with one exchange."""

    def about(f, number) -> Column:
        c = quoted(f.name)
        return F.approx_count_distinct(as_text(c, f.dataType) if isinstance(f.dataType, NESTED) else c, ABOUT).alias("unique")

    def sketch(f, number) -> Column:
        return (F.kll_sketch_agg_double(number, SKETCH) if kind(f.dataType) in ("integer", "float") else F.lit(None).cast("binary")).alias("sketch")

    def places(f, number) -> Column:
        return (F.histogram_numeric(number, F.lit(PLACES)) if kind(f.dataType) in ("integer", "float") else F.lit(None).cast("array<struct<x:double,y:double>>")).alias("places")

    some = F.col("n") > 0
    shares = (0.25, 0.5, 0.75)
    ranks = [(0, nearest(0.25)), *[(1, middle) for middle in MIDDLE], (2, nearest(0.75))]

    def mean(rank) -> Column:
        """Of the bin that holds a rank."""
        before = F.aggregate("places", F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("at")), lambda a, b: F.struct((a["upto"] + b["y"]).alias("upto"), (a["at"] + (a["upto"] + b["y"] <= rank(F.col("n"))).cast("int")).alias("at")))
        return F.get("places", before["at"])["x"]

    def held(k: int) -> Column:
        """The sketch's value for a rank; where that isn't near the bin that holds the rank, the next value of the sketch that is, or the bin's mean."""
        # A rank that is off by a few rows may lie across a gap, from a value to quite another one.
        v, m = F.get("quartiles", F.lit(ranks[k][0])), F.get("means", F.lit(k))
        reach = F.greatest((F.col("max") - F.col("min")) * REACH, F.abs(m) * NOISE)
        near = F.filter(F.array_append("points", v), lambda p: F.abs(p - m) <= reach)
        inside = lambda x, low, high: F.least(F.greatest(x, low), high)
        return F.when(F.size(near) > 0, inside(v, F.array_min(near), F.array_max(near))).when(some, inside(m, F.col("min"), F.col("max")))

    # As many values at even ranks as ``POINTS`` stand for all.
    points = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)]))
    width = (F.col("max") - F.col("min")) / bins
    below = lambda k: F.size(F.filter("points", lambda v: v <= F.when(k == bins, F.col("max")).otherwise(F.col("min") + width * k)))
    upto = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.round(below(k) * F.col("n") / POINTS).cast("long"))
    bars = F.transform(upto, lambda n, k: n - F.when(k > 0, F.get(upto, k - 1)).otherwise(F.lit(0)))
    quartiles = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(q) for q in shares]))
    found = _scalars(df, about, sketch, places).withColumns({"points": F.when(some, points), "quartiles": F.when(some, quartiles), "means": F.array(*[mean(rank) for _, rank in ranks])})
    return _shown(found.select("*", held(0).alias("q1"), ((held(1) + held(2)) / 2).alias("median"), held(3).alias("q3"), F.when(some, bars).alias("histogram")))


def nearest_ranks(stacked: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(column, q_0, q_1, ...): of (column, value) rows the element whose index is floor((n - 1) share + 1/2), for each share."""
    counted = stacked.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("many"))
    return ranked(counted, "column", [nearest(s) for s in shares])


def quantile(df: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row with the nearest-rank quantiles q_0, q_1, ... of a column of any size."""
    return nearest_ranks(df.select(F.lit(column).alias("column"), finite(quoted(column)).alias("value")), shares)


def top_values(df: DataFrame, top: int = TOP) -> DataFrame:
    """column, value, count: the most common values of each text column, and all of each boolean one."""
    columns = [f.name for f in df.schema if kind(f.dataType) in ("string", "boolean")]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, count long")
    counted = _stacked(df, columns, lambda c: as_text(quoted(c), dtype(df, c))).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counted.withColumn("place", place).where(F.col("place") <= top).select("column", F.substring("value", 1, SHOWN).alias("value"), "count")


def _bin(v: Column, bins: int) -> Column:
    """The bin, from 1, of a value between lo and hi."""
    width = (F.col("hi") - F.col("lo")) / bins
    return F.when(width > 0, F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((v - F.col("lo")) / width)))).otherwise(1).cast("int")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin (from 1), low, high, count, cumulative_share: equal widths from min to max, each bin with its upper end."""
    v = finite(quoted(column))
    values = df.select(v.alias("v")).where("v IS NOT NULL")
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    width, number = (F.col("hi") - F.col("lo")) / bins, _bin(F.col("v"), bins)
    counted = values.crossJoin(F.broadcast(bounds)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))  # one row of bounds
    every = bounds.where("n > 0").select("lo", "hi", "n", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    joined = every.join(F.broadcast(counted), "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    running = F.sum("count").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # as many rows as bins
    return joined.select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("low"), (F.col("lo") + width * F.col("bin")).alias("high"), "count", (running / F.col("n")).alias("cumulative_share"))


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """a, b, r for all pairs of number columns, both ways and with themselves, over rows that have both.

    Few columns take one aggregate. Of many, one pass gives means and spreads and one the sums of all pairs: rows are arrays of numbers, blocks of rows become matrices whose
    products are the sums that all pairs need, and the sums of tasks are added. A column's numbers are taken less
    their mean and over their spread, so that sums of squares lose little.
    """
    columns = columns or _numbers(df)
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "a string, b string, r double")
    same = spark.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    if len(columns) <= FEW:

        def r_of(a: str, b: str) -> Column:
            x, y = finite(quoted(a)), finite(quoted(b))
            c = F.corr(F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))
            return F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(~F.isnan(c), c).alias("r"))

        half = df.agg(F.array(*[r_of(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]).alias("all")).select(F.explode("all").alias("p")).select("p.*").where("r IS NOT NULL")
        return half.unionAll(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionAll(same)
    rows = df.select(F.array(*[finite(quoted(c)) for c in columns]).alias("x"))
    first = df.agg(*[F.struct(F.avg(finite(quoted(c))).alias("m"), F.stddev_pop(finite(quoted(c))).alias("s")).alias(f"c{k}") for k, c in enumerate(columns)]).first()  # one row
    middle = np.array([first[k]["m"] or 0.0 for k in range(len(columns))])
    spread = np.array([first[k]["s"] or 1.0 for k in range(len(columns))])
    size = len(columns)

    def run(batches):
        total = np.zeros((6, size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.column(0).slice(at, BLOCK)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
                here = ~np.isnan(x)
                x = np.where(here, (x - middle) / spread, 0.0)
                one = here.astype(np.float64)
                both, xs, xx, xy = one.T @ one, x.T @ one, (x * x).T @ one, x.T @ x
                total += np.stack([both, xs, xs.T, xx, xx.T, xy])
        for i in range(size):  # a row for each column, so that no row is larger than a few columns
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[:, i, i + 1 :].ravel()], pa.list_(pa.float64()))], ["i", "sums"])

    found = rows.mapInArrow(run, "i int, sums array<double>").select("i", F.posexplode("sums").alias("at", "v")).groupBy("i", "at").agg(F.sum("v").alias("v"))
    # Of column i: six sums with each later column.
    later = F.lit(size - 1) - F.col("i")
    pairs = found.select("i", (F.col("i") + 1 + F.col("at") % later).alias("j"), F.floor(F.col("at") / later).cast("int").alias("k"), "v")
    held = pairs.groupBy("i", "j").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, name in enumerate(("n", "x", "y", "xx", "yy", "xy"))])
    n, vx, vy = F.col("n"), F.expr("xx - x * x / n"), F.expr("yy - y * y / n")
    # What is left of a spread by rounding is none.
    r = F.when((n > 1) & (vx > LOST * F.col("xx")) & (vy > LOST * F.col("yy")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr("xy - x * y / n") / F.sqrt(vx * vy))))
    names = F.array(*[F.lit(c) for c in columns])
    half = held.where("n > 0").select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r")).where("r IS NOT NULL")
    both = half.select(F.explode(F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))).alias("p")).select("p.*")
    return both.unionAll(same)


def strongest_correlations(df: DataFrame, columns: list[str] | None = None, least: float = 0.3, most: int = 15) -> DataFrame:
    """a, b, r of the pairs with the largest |r|."""
    pairs = correlations(df, columns).where((F.col("a") < F.col("b")) & (F.abs("r") >= least))
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(most)


def missing_pairs(df: DataFrame) -> DataFrame:
    """a, b, rows where both are null, for columns with nulls; the diagonal counts a column's own."""
    # Rows of one pattern of nulls count together, so that pairs are made of few rows.
    pattern = F.filter(F.array(*[F.when(quoted(c).isNull(), F.lit(c)) for c in df.columns]), lambda x: x.isNotNull())
    patterns = df.groupBy(pattern.alias("nulls")).agg(F.count(F.lit(1)).alias("many")).where(F.size("nulls") > 0)
    one = patterns.select(F.explode("nulls").alias("a"), "nulls", "many").select("a", F.explode("nulls").alias("b"), "many")
    return one.groupBy("a", "b").agg(F.sum("many").alias("rows"))


def distribution(df: DataFrame, column: str, bins: int = DISTRIBUTION_BINS) -> DataFrame:
    """By the column's type: a histogram of numbers (items of lists of numbers too), else value, count of the most common."""
    dt = dtype(df, column)
    what = kind(dt)
    if what == "list":
        items = df.select(F.explode(quoted(column)).alias(column)).where(quoted(column).isNotNull())
        return distribution(items, column, bins)
    if what in ("integer", "float"):
        return histogram(df, column, bins)
    if what in ("binary", "null"):
        return df.sparkSession.createDataFrame([], "value string, count long")
    counted = df.select(F.substring(as_text(quoted(column), dt), 1, SHOWN).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "value").limit(bins)


def distribution_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: total (values that aren't null, items of lists), unique, shown (how many rows ``distribution`` shows), and of numbers min, max, mean."""
    dt = dtype(df, column)
    if kind(dt) == "list":
        return distribution_summary(df.select(F.explode(quoted(column)).alias(column)), column)
    number = finite(quoted(column)) if kind(dt) in ("integer", "float") else F.lit(None).cast("double")
    text = as_text(quoted(column), dt)
    counted = df.select(text.alias("key"), number.alias("v")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.first("v").alias("v"))
    out = counted.agg(F.coalesce(F.sum("many"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"), F.min("v").alias("min"), F.max("v").alias("max"), F.try_divide(F.sum(F.col("v") * F.col("many")), F.sum(F.when(F.col("v").isNotNull(), F.col("many")))).alias("mean"))
    return out.select("total", "unique", F.least("unique", F.lit(DISTRIBUTION_BINS)).alias("shown"), "min", "max", "mean")


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row low, high."""
    if method == "iqr":
        q = quantile(df, column, (0.25, 0.75))
        spread = (F.col("q_1") - F.col("q_0")) * threshold
        return q.select((F.col("q_0") - spread).alias("low"), (F.col("q_1") + spread).alias("high"))
    if method == "zscore":
        v = finite(quoted(column))
        held = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s")).where("s > 0")
        return held.select((F.col("m") - F.col("s") * threshold).alias("low"), (F.col("m") + F.col("s") * threshold).alias("high"))
    raise ValueError(f"unknown method {method!r}")


def outliers(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """The rows strictly outside the bounds, with them; none for columns that aren't numbers."""
    if kind(dtype(df, column)) not in ("integer", "float"):
        return df.where(F.lit(False)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    v = finite(quoted(column))
    bounds = outlier_bounds(df, column, method, threshold)
    return df.crossJoin(F.broadcast(bounds)).where((v < F.col("low")) | (v > F.col("high")))  # one row of bounds


def outlier_report(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5, most: int = 1000) -> dict:
    """The first values, all counted, and the bounds."""
    found = outliers(df, column, method, threshold)
    bounds = outlier_bounds(df, column, method, threshold).first() if kind(dtype(df, column)) in ("integer", "float") else None
    values = [r[0] for r in found.select(quoted(column)).orderBy(quoted(column)).limit(most).collect()]
    return {"method": method, "threshold": threshold, "count": found.count(), "values": values, "bounds": tuple(bounds) if bounds else None}


def column_roles(profiled: DataFrame) -> DataFrame:
    """column, role: Constant, Categories, Identifier-like or Mixed."""
    u, p = F.col("unique"), F.col("unique_percent")
    return profiled.select("column", F.when(u <= 1, "Constant").when((u <= 20) | (p < 5), "Categories").when(p >= 90, "Identifier-like").otherwise("Mixed").alias("role"))
