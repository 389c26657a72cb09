"""Reading tables from files: O-02 to O-11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_files
from .rowid import with_file_row_id

# Formats by file name; the longest ending counts.
ENDINGS = {
    ".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json.gz": "json",
    ".jsonl.gz": "jsonl", ".ndjson.gz": "jsonl", ".csv.gz": "csv", ".tsv.gz": "tsv", ".orc": "orc", ".avro": "avro", ".feather": "arrow", ".arrow": "arrow", ".ipc": "arrow",
}


def format_of(path: str) -> str:
    """The format of a file, by the longest known ending of its name."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    found = [e for e in ENDINGS if name.endswith(e)]
    if not found:
        raise ValueError(f"{path!r} has no known ending; give a format out of {', '.join(sorted(set(ENDINGS.values())))}")
    return ENDINGS[max(found, key=len)]


def _json_is_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank is a value by itself and no array begins."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).select(F.trim("value").alias("v"), F.try_parse_json("value").isNotNull().alias("whole")).collect()
    return not first or (not first[0]["v"].startswith("[") and first[0]["whole"])


def load(spark: SparkSession, path: str, format: str | None = None, row_id: bool = False, schema=None, **options) -> DataFrame:  # noqa: A002
    """A table from a file, a folder or a glob; ``row_id`` adds the place of each row.

    CSV and TSV have a header and inferred types unless told otherwise (``schema=`` for exact types);
    ``multiLine`` lets values hold line feeds, which keeps a file in one piece. JSON may be an array,
    one object, or lines, plain or gzipped; a gzipped file is one task, so repartition after it.
    """
    what = format or format_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if what in ("csv", "tsv"):
        settings = {"header": True, "sep": "\t" if what == "tsv" else ",", "inferSchema": schema is None} | options
        df = reader.options(**settings).csv(path)
    elif what == "json":
        df = reader.options(**({"multiLine": not _json_is_lines(spark, path)} | options)).json(path)
    elif what == "jsonl":
        df = reader.options(**options).json(path)
    elif what in ("parquet", "orc"):
        df = reader.options(**options).format(what).load(path)
    elif what == "avro":
        df = reader.options(**options).format("avro").load(path)
    elif what == "arrow":
        arrow_files.enable(spark)
        df = reader.options(**options).format("loomsheet_arrow").load(path)
        if row_id:
            raise ValueError("Arrow files carry no places that Spark sees; number the rows by a key with number_rows")
    else:
        raise ValueError(f"unknown format {what!r}")
    return with_file_row_id(df, what == "parquet") if row_id else df
