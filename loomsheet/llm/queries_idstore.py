"""The registered query of token-id output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import scratch
from . import idstore
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op11_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    idstore.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    cut = idstore.read(spark, idstore.lookup(idstore.keys(spark, path), path), path, idstore.crcs, "long")
    return cut.select("doc_id", "start", "n_tokens", cut["value"].alias("ids_crc32"))


QUERIES = {"op11_id_store": op11_id_store}
