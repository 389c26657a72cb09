"""Row numbers: by the place in files, and by an order, without bringing all rows to one task (O-11)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import hashable

ROW_ID = "row_id"
FEWEST, MOST = 64, 4096
SPARE = 2  # rows drawn for each range
ROWS_A_TASK = 100_000  # that a task numbers, while there are no more tasks than shuffle partitions


def _running(counts: DataFrame, order: list[str]) -> DataFrame:
    """Adds start: what all earlier rows of a small table count."""
    return counts.withColumn("start", F.sum("many").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("many"))


def with_file_row_id(read: DataFrame, row_index: bool, name: str = ROW_ID, offset: int = 0) -> DataFrame:
    """Numbers the rows of a file scan: files by path, rows by place.

    Parquet knows a row's index in its file; other formats number rows within a split, and splits
    are ordered by where they start. Only one row for each file or split is shared out.
    """
    if row_index:
        rows = read.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
        starts = _running(rows.groupBy("__f").agg(F.count(F.lit(1)).alias("many")), ["__f"]).select("__f", "start")
        joined = rows.join(starts, "__f").withColumn(name, F.col("start") + F.col("__r") + offset)
        return joined.select(name, *read.columns)
    rows = read.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    splits = rows.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("many"), F.min("__m").alias("first"))
    starts = _running(splits, ["__f", "__b"]).select("__f", "__b", "first", "start")
    joined = rows.join(starts, ["__f", "__b"]).withColumn(name, F.col("start") + F.col("__m") - F.col("first") + offset)
    return joined.select(name, *read.columns)


def _split(df: DataFrame) -> Column:
    """A hash of the file split that a row is read from, where the table is a scan; the same for all rows elsewhere."""
    if df._jdf.queryExecution().analyzed().collectLeaves().size() == 1 and not df.isStreaming:
        return F.xxhash64(F.input_file_name(), F.input_file_block_start())
    return F.lit(0).cast("long")


def _ranged(df: DataFrame, order_by: list[str], descending: bool) -> tuple[DataFrame, list[Column], int]:
    """Adds __bucket, the number of the range of the order that a row lies in, and gives the order within and how many tasks the rows are for."""
    own = _split(df)
    df = df.withColumn("__h", F.xxhash64(*hashable(df))).withColumn("__t", own)
    order_by = [*order_by, "__h", "__t"]
    order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order_by]
    key = F.struct(*[x for c in order_by for x in (F.col(c).isNull(), F.col(c))])
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST, max(FEWEST, shuffles))
    keyed = df.withColumn("__k", key)
    # The keys of the rows with the smallest hashes, each row with one of its own: each task keeps few, and nothing else is
    # shuffled. The bounds are drawn once, here, so that counts and places go by the same ones.
    picked = keyed.select("__k", F.xxhash64("__h", "__t", F.monotonically_increasing_id()).alias("__p")).orderBy("__p").limit(SPARE * n)
    bounds = picked.agg(F.array_sort(F.collect_set("__k")).alias("__bounds"), F.count(F.lit(1)).alias("drawn"), F.max("__p").alias("last"))
    held = bounds.collect()  # SPARE * n keys at most
    drawn, last = held[0]["drawn"], held[0]["last"]
    # The largest of the smallest hashes tells about how many rows there are.
    rows = drawn if drawn < SPARE * n else drawn * 2.0**64 / (last + 2.0**63 + 1)
    one = df.sparkSession.createDataFrame(held, bounds.schema).select("__bounds").scalar()
    # How many bounds a key reaches, by halves; past the last bound there is none to reach. A plain expression of each half is compiled.
    found = keyed.withColumn("__low", F.lit(0))
    half = 1 << len(held[0]["__bounds"]).bit_length()
    while half := half // 2:
        found = found.withColumn("__low", F.col("__low") + F.when(F.get(one, F.col("__low") + (half - 1)) <= F.col("__k"), half).otherwise(0))
    found = found.withColumn("__bucket", -F.col("__low") if descending else F.col("__low")).drop("__low", "__k")
    return found, order, max(1, min(shuffles, math.ceil(rows / ROWS_A_TASK)))


def _in_ranges(df: DataFrame, order_by: list[str], descending: bool) -> tuple[DataFrame, list[Column]]:
    return _ranged(df, order_by, descending)[:2]


def number_rows(df: DataFrame, order_by: list[str], name: str = ROW_ID, descending: bool = False) -> DataFrame:
    """Adds a dense number from 0 in the given order, nulls last.

    Bounds drawn from the data in a job of its own, about as many as there are shuffle partitions, cut the order into
    ranges; a row's number is the rows of earlier ranges plus its place in its own. Rows with equal keys
    are ordered by a hash of the row, and equal rows of a scan by the file split that they come from, so that a
    frequent key or row spreads over ranges; only equal rows of one split keep to one, and equal rows of
    what isn't a scan. Ranges go to a task for ``ROWS_A_TASK`` rows, however few bytes these have.
    """
    names = df.columns
    bucketed, order, tasks = _ranged(df, order_by, descending)
    starts = _running(bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("many")), ["__bucket"]).select("__bucket", "start")
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    out = bucketed.repartition(tasks, "__bucket").withColumn("__place", place).join(F.broadcast(starts), "__bucket")  # a row for each bucket
    return out.withColumn(name, (F.col("start") + F.col("__place") - 1).cast("long")).select(name, *[c for c in names if c != name])
