"""The registered queries of personal data and secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import pii, secrets
from .common import table


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


QUERIES = {"op2_pii": op2_pii, "op3_secrets": op3_secrets}
