"""A folder that the driver and all executors share, for tables that an operator writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only where that is unset and all runs on one machine, as in tests, a folder of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return root.rstrip("/")


def has_shared(spark: SparkSession) -> bool:
    """Whether ``scratch`` can give a path."""
    return bool(spark.sparkContext.getConf().get("spark.checkpoint.dir", None)) or spark.sparkContext.master.startswith("local[")


def bytes_under(spark: SparkSession, path: str) -> int:
    """The bytes of the files in a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
