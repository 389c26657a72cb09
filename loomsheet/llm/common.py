"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch

SHARES = 2**30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Spark removes the shuffle files of a write once it has ended, and not only when the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def bounded(df: DataFrame, most: str = MOST) -> DataFrame:
    """``df``, for a function over Arrow batches. From now on the session's batches are bounded by bytes, since texts may be long."""
    df.sparkSession.conf.set(BATCH, most)
    return df


class Tables:
    """The tables that an operator writes to the shared folder as Parquet and reads again, by name.

    Writing one cuts the lineage. ``drop`` deletes those that no later step reads; ``drop_all`` all but
    those named, once a result that doesn't need them is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        before = self.spark.conf.get(CLEANED)
        self.spark.conf.set(CLEANED, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANED, before)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        files = self.spark._jvm.org.apache.hadoop.fs
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            held = files.Path(path)
            held.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(held, True)

    def drop_all(self, *but: str) -> None:
        self.drop(*[name for name in self.paths if name not in but])


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet to the shared folder and reads it back."""
    return Tables(df.sparkSession)(df, name)


def text_of(column: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def learnable(column: str = "doc_id") -> Column:
    """Rows whose labels may be learned from; the rest are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(~learnable(column), F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column without nulls, without a copy."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a piece has about ``most_bytes`` of text, or one row."""
    if not batch.num_rows:
        return
    ends = np.cumsum([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()])
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """At most ``most`` labelled texts to learn from, half of each class where there are enough, and how many labels of each class there are.

    A bounded, documented sample: the learnable labels with the smallest hashes of their ids,
    which doesn't depend on partitioning. Only these rows' texts come to the driver; of an id's texts, the
    one with the smallest hash, so that repeated ids bring no more.
    """
    ids = labels.where(learnable() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    key = F.xxhash64(F.col("doc_id"), F.lit(7))
    many = {r["label"]: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    picked = None
    for value in (0, 1):
        # A share of the hashes that holds four times what is wanted, so that no task sorts more.
        low = F.pmod(key, F.lit(SHARES)) < min(SHARES, -(-4 * (most // 2) * SHARES // max(1, many.get(value, 1))))
        part = ids.where((F.col("label") == value) & low).orderBy(F.pmod(key, F.lit(SHARES)), key, "doc_id").limit(most // 2)
        picked = part if picked is None else picked.unionByName(part)
    rows = (
        docs.select("doc_id", text_of().alias("text"))
        .join(F.broadcast(picked), "doc_id")  # bounded by ``most`` rows
        .groupBy("doc_id", "label")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .collect()
    )
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"], r["label"]))], many
