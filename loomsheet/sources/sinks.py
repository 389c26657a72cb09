"""Writing tables: O-13 to O-18."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.values import NESTED, hashable, quoted, unused
from ..operators.predicates import apply_filters
from .shared import bytes_under

FORMATS = {"parquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "orc": "orc"}
ROWS_A_FILE = 1_000_000


def _dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a value together; those of a frequent value are numbered and go to as many tasks as they fill files.

    All files of a frequent value but its last have ``ROWS_A_FILE`` rows, so that a value has no more files than its rows need,
    also where tasks take several. Numbers go by ranges of the rows' hashes, four for each file.
    """
    own = unused("__by_", df.columns)
    keys, names, kept = [quoted(c) for c in by], [f"{own}{k}" for k in range(len(by))], [quoted(c) for c in df.columns]
    n, cut, many, of, start, place, file = (f"{own}{x}" for x in ("n", "cut", "many", "of", "start", "place", "file"))
    counted = df.groupBy(*[c.alias(x) for c, x in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > ROWS_A_FILE)
    if counted.isEmpty():
        return df.repartition(*keys)
    hot = F.broadcast(counted)  # a row for ROWS_A_FILE rows at most
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(x)) for c, x in zip(keys, names, strict=True)])
    drawn = F.xxhash64(*hashable(df))
    frequent = df.join(hot, same).withColumn(cut, F.pmod(drawn, F.ceil(F.col(n) * 4 / ROWS_A_FILE).cast("int")))
    counts = frequent.groupBy(*names, cut).agg(F.count(F.lit(1)).alias(many))
    before = F.sum(many).over(Window.partitionBy(*names).orderBy(cut).rowsBetween(Window.unboundedPreceding, 0)) - F.col(many)
    starts = counts.select(*[F.col(x).alias(f"{x}_") for x in names], F.col(cut).alias(of), before.alias(start))  # four rows for each file
    at = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in names], F.col(cut) == F.col(of))
    numbered = frequent.withColumn(place, F.row_number().over(Window.partitionBy(*names, cut).orderBy(drawn)) - 1).join(F.broadcast(starts), at)
    dealt = numbered.select(*kept, F.floor((F.col(start) + F.col(place)) / ROWS_A_FILE).alias(file))
    rest = df.join(hot, same, "left_anti").select(*kept, F.lit(0).cast("long").alias(file))
    return dealt.unionByName(rest).repartition(*keys, file).select(*kept)


def write(df: DataFrame, path: str, format: str = "parquet", compression: str | None = None, mode: str = "errorifexists", single_file: bool = False, partition_by: list[str] | None = None, **options) -> None:  # noqa: A002
    """A folder of part files, each CSV part with its header; zstd for Parquet unless told otherwise."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; known are {', '.join(FORMATS)}")
    if format in ("csv", "tsv") and (nested := [f.name for f in df.schema if isinstance(f.dataType, NESTED)]):
        raise ValueError(f"{format} can't hold nested columns: {', '.join(nested)}")
    out = df.coalesce(1) if single_file else df
    if partition_by:
        out = _dealt(df, partition_by)
    writer = out.write.mode(mode).options(**options)
    if format in ("csv", "tsv"):
        writer = writer.option("header", True).option("sep", "\t" if format == "tsv" else ",")
    compression = compression or ("zstd" if format == "parquet" else None)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("maxRecordsPerFile", ROWS_A_FILE)
    writer.format(FORMATS[format]).save(path)


def export(df: DataFrame, path: str, format: str = "parquet", columns: list[str] | None = None, filters: list[dict] = (), compression: str | None = None, partition_by: list[str] | None = None, mode: str = "errorifexists") -> dict:  # noqa: A002
    """Filters, projects and writes in one scan; says what was written."""
    seen = Observation()
    out = apply_filters(df, list(filters))
    if columns:
        out = out.select(*[quoted(c) for c in columns])
    out = out.observe(seen, F.count(F.lit(1)).alias("rows"))
    write(out, path, format, compression, mode, partition_by=partition_by)
    return {"path": path, "rows": seen.get["rows"], "columns": len(out.columns), "format": format, "bytes": bytes_under(df.sparkSession, path)}


def save_as(df: DataFrame, path: str, format: str = "parquet", filters: list[dict] = (), overwrite: bool = False) -> dict:  # noqa: A002
    """A new table from a view; refuses to write over another unless told to."""
    return export(df, path, format, filters=filters, mode="overwrite" if overwrite else "errorifexists")
