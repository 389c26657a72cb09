"""Tables bucketed by a key in a folder of their own, so that joins on the key need no shuffle (O-67, O-68)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _name(path: str) -> str:
    """The catalog's name for the folder; a session knows it once the folder is written or read."""
    return f"loomsheet_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def buckets_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A file for each bucket, sorted by the key."""
    dealt = df.repartition(buckets, f"`{key}`")
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(_name(path))


def read(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """The table, which knows its buckets, whichever session wrote it."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = spark.read.parquet(path)._jdf.schema().toDDL()
        quoted = f"`{key}`"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
