"""The registered query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .common import table


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality": op10_quality}
