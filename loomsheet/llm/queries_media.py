"""The registered query of media columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import media
from .common import table


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"))
    return media.read_back(stored)


def op7_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each clip of each document's film."""
    return media.clips(media.store(table(spark, sf_dir, "documents")))


QUERIES = {"op7_media": op7_media, "op7_media_clips": op7_media_clips}
