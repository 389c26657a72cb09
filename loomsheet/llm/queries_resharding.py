"""The registered query of resharding: from one shard for each hash of a source to 40 of equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch
from . import resharding
from .common import table

SHARDS, OLD = 40, 24


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("old_shard", F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD)).cast("int"))
    path = scratch(spark, "shards")
    resharding.lay(docs, F.col("old_shard"), path)
    before = resharding.held(spark, docs, path)
    resharding.rewrite(before, resharding.plan(resharding.sized(before, F.col("shard")), SHARDS, OLD), path, F.col("shard"))
    # What is returned is read from the new shards.
    after = resharding.held(spark, docs, path)
    placed = resharding.sized(after, F.col("old_shard"), F.col("shard"))
    planned = resharding.with_slots(placed)
    return planned.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


QUERIES = {"op5_resharding": op5_resharding}
