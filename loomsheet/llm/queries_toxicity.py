"""The registered query of toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import toxicity
from .common import table


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
