"""Which steps a streaming DataFrame may take, and keyed counts over time (O-110)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_streaming(df: DataFrame, op: str, params: dict) -> None:
    """Raises for a step that needs the whole table or an order when the table is a stream."""
    if not df.isStreaming:
        return
    from ..plans.registry import FUNCTIONS, ROW_WISE

    fills_by_value = op == "fill_missing" and params.get("strategy") in ("value", "zero")
    if FUNCTIONS[op].scope != ROW_WISE and not fills_by_value:
        raise ValueError(f"{op} needs the whole table and can't run on a stream")


def windowed_counts(df: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, key, count and sum of values of each tumbling window; on a stream, rows later than ``late`` drop."""
    held = df.withWatermark(time, late) if df.isStreaming else df
    counted = held.groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("start"), key, "count")
