"""Operators must give the same rows however the input is partitioned, and on streams what they give on tables."""

import pytest
from pyspark.sql import functions as F

from loomsheet.operators import columns, edits, profile, reshape, rows, search, versions
from loomsheet.sources.rowid import number_rows
from loomsheet.streaming.guard import windowed_counts

KEY = ["o_orderkey"]
OPERATORS = {
    "dedupe": lambda df: rows.dedupe(df, ["o_custkey"], KEY),
    "first": lambda df: reshape.group_aggregate(df, ["o_orderstatus"], "first", "o_totalprice", "x", KEY),
    "list": lambda df: reshape.group_aggregate(df, ["o_custkey"], "list", "o_orderkey", "x", KEY),
    "top": lambda df: rows.top_n(df, "o_orderpriority", 7, order_by=KEY),
    "sample": lambda df: rows.sample_rows(df, 33, 1, KEY),
    "page": lambda df: rows.page(df, 5, 10, sorts=[{"column": "o_orderstatus"}], order_by=KEY),
    "fill": lambda df: columns.ordered_fill(df.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice"))), "o_totalprice", True, "o_orderkey", 100),
    "mode": lambda df: columns.fill_missing(df.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O"))), "o_orderstatus", "mode"),
    "number": lambda df: number_rows(df, ["o_orderstatus", "o_orderkey"]),
    "quantile": lambda df: profile.quantile(df, "o_totalprice"),
    "histogram": lambda df: profile.histogram(df, "o_totalprice", 9).select("bin", "count"),
    "outliers": lambda df: profile.outliers(df, "o_totalprice", "iqr", 0.1),
    "search": lambda df: search.search_indexed(df.withColumnRenamed("o_orderkey", "row_id"), search.index_rows(df.withColumnRenamed("o_orderkey", "row_id"), 50), "urgent 19", block_rows=50),
    "edits": lambda df: edits.apply_changes(df, [{"op": "delete", "row_id": 3}, {"op": "update", "row_id": 4, "values": {"o_orderstatus": None}}], "o_orderkey"),
    "undo": lambda df: versions.apply_undo(df.where("o_orderkey % 3 > 0"), *versions.build_undo(df, df.where("o_orderkey % 3 > 0"), ["o_orderstatus"], "o_orderkey"), "o_orderkey"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_partitions_do_not_matter(spark, sf, name):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    one, eight = (sorted(map(str, OPERATORS[name](orders.repartition(n, "o_totalprice")).collect())) for n in (1, 8))
    assert one == eight and one


def test_windowed_counts_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(str, windowed_counts(events, "ts", "event_type").collect()))
    assert sorted(map(str, spark.table("counts").collect())) == want
