"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

1. quality: the compression classifier learns from the labels; documents that it rejects go.
2. near_duplicates: n-gram Jaccard join on five words and a similarity of 0.8; of each group the
   document with the smallest doc_id stays.
3. decontamination: documents into which a benchmark item is leaked go.
4. secrets: secrets in texts are replaced by a mark; n_chars follows.
5. encode: the remaining texts become byte-level BPE ids.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of
documents. Null texts, empty texts and empty tables pass through as each operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsheet.llm import bpe, jaccard, quality, secrets, tiling
from loomsheet.llm.common import Tables, table

WORDS, PERCENT = 5, 80
RANKS = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, WORDS, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secrets.redact(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens."""
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("encode", encode),
]

# SQL can't express compression, tiling or merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes once the next is written."""
    docs, keep = table(spark, sf_dir, "documents"), Tables(spark)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        keep.drop_all(f"stage-{name}")
    return docs
