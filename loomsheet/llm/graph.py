"""Connected components of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, keep: Tables | None = None) -> DataFrame:
    """(v, label) for every end of ``links`` (a, b): the smallest end that links reach.

    Each round takes the smallest label among the neighbours, then the label of that label, so that
    long chains halve. A round is written to the shared folder, the round before it deleted; the loop
    ends when nothing changes. The result is the table ``labels`` of ``keep``.
    """
    keep = keep or Tables(links.sparkSession)
    keep.drop("labels")
    both = links.select(F.col("a").alias("v"), F.col("b").alias("w"))
    edges = keep(both.unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w"))).where("v <> w").distinct(), "edges")
    now = keep(edges.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")), "labels")
    while True:
        near = edges.join(now.select(F.col("v").alias("w"), F.col("label").alias("other")), "w").groupBy("v").agg(F.min("other").alias("other"))
        step = now.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = now.select(F.col("v").alias("label"), F.col("label").alias("further"))
        moved = step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        moved = keep(moved, "moved")
        done = moved.where("label <> old").isEmpty()
        keep.drop("labels")
        keep.paths["labels"] = keep.paths.pop("moved")
        now = moved.select("v", "label")
        if done:
            keep.drop("edges")
            return now
