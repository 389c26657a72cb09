"""Arrow IPC and Feather files as a data source: a task for each run of record batches, filters applied as they are read (O-10)."""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20  # of a file that a task reads


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or URI, as Arrow opens it on any machine (local, HDFS, S3, GCS), and the path there."""
    return stores.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def files_of(path: str) -> list[str]:
    """The files of a file, a folder or a pattern in the last part, as paths of their store."""
    store, place = store_of(path)
    folder, _, last = place.rpartition("/")
    if any(c in last for c in "*?["):
        inside = store.get_file_info(stores.FileSelector(folder))
        return sorted(f.path for f in inside if f.type == stores.FileType.File and fnmatch.fnmatch(f.base_name, last))
    what = store.get_file_info(place)
    if what.type == stores.FileType.Directory:
        return sorted(f.path for f in store.get_file_info(stores.FileSelector(place)) if f.type == stores.FileType.File and not f.base_name.startswith((".", "_")))
    return [place] if what.type == stores.FileType.File else []


def write(df: DataFrame, path: str) -> int:
    """A file for each task; the number of rows. The files are there once all tasks have written theirs."""
    df.sparkSession.dataSource.register(ArrowFiles)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("loomsheet_arrow").mode("append").save(path)
    return seen.get["rows"]


def enable(spark) -> None:
    """Registers the source, and lets filters reach it."""
    spark.dataSource.register(ArrowFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


class ArrowFiles(DataSource):
    """``spark.read.format("loomsheet_arrow").load(path)``, and ``df.write`` likewise; option ``splitBytes`` cuts files for tasks."""

    @classmethod
    def name(cls) -> str:
        return "loomsheet_arrow"

    def _files(self) -> list[str]:
        found = files_of(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        return found

    def schema(self) -> StructType:
        with store_of(self.options["path"])[0].open_input_file(self._files()[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.options["path"], self._files(), schema.names, int(self.options.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)


@dataclass
class Batches(InputPartition):
    file: str
    start: int
    stop: int


def _plain(dt: pa.DataType) -> bool:
    """Types whose values Arrow compares as Spark does."""
    return pa.types.is_integer(dt) or pa.types.is_string(dt) or pa.types.is_large_string(dt) or pa.types.is_boolean(dt)


def condition(found: Filter, schema: pa.Schema) -> pc.Expression | None:
    """A filter as Arrow's expression, or None where Arrow might keep other rows than Spark."""
    if len(found.attribute) != 1 or found.attribute[0] not in schema.names:
        return None
    column = pc.field(found.attribute[0])
    if isinstance(found, (IsNull, IsNotNull)):
        return column.is_null() if isinstance(found, IsNull) else column.is_valid()
    if not _plain(schema.field(found.attribute[0]).type):
        return None
    value = found.value
    ways = {
        EqualTo: lambda: column == value, GreaterThan: lambda: column > value, GreaterThanOrEqual: lambda: column >= value, LessThan: lambda: column < value, LessThanOrEqual: lambda: column <= value,
        In: lambda: column.isin([v for v in value if v is not None]), StringStartsWith: lambda: pc.starts_with(column, value), StringEndsWith: lambda: pc.ends_with(column, value), StringContains: lambda: pc.match_substring(column, value),
    }
    return ways[type(found)]() if type(found) in ways else None


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, files: list[str], names: list[str], split: int):
        self.path, self.files, self.names, self.split, self.filters = path, files, names, split, []

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:  # noqa: N802
        """Batches lose rows that can't be wanted before they reach Spark, which applies all filters itself."""
        self.filters = filters
        return filters

    def partitions(self) -> list[InputPartition]:
        """Runs of record batches, from the files' footers."""
        store, found = store_of(self.path)[0], []
        for file in self.files:
            with store.open_input_file(file) as f:
                many, size = pa.ipc.open_file(f).num_record_batches, f.size()
            step = max(1, int(many * self.split / max(1, size)))
            found += [Batches(file, k, min(k + step, many)) for k in range(0, many, step)]
        return found or [Batches(self.files[0], 0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        with store_of(self.path)[0].open_input_file(partition.file) as f:
            reader = pa.ipc.open_file(f)
            wanted = [e for e in (condition(x, reader.schema) for x in self.filters) if e is not None]
            for k in range(partition.start, partition.stop):
                batch = reader.get_batch(k)
                if wanted:
                    yield from pa.Table.from_batches([batch]).filter(reduce(lambda a, b: a & b, wanted)).select(self.names).to_batches()
                else:
                    yield batch.select(self.names)


@dataclass
class Written(WriterCommitMessage):
    unfinished: str
    name: str


class ArrowWriter(DataSourceArrowWriter):
    """Each task writes a hidden file; the driver gives those of the tasks that count their names."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        schema, unfinished = to_arrow_schema(self.schema), f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(unfinished) as f, pa.ipc.new_file(f, schema) as out:
            for batch in iterator:
                out.write_batch(batch.cast(schema))
        return Written(unfinished, f"{folder}/part-{TaskContext.get().partitionId():05d}-{self.job}.arrow")

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        old = files_of(self.path) if self.overwrite and store.get_file_info(folder).type == stores.FileType.Directory else []
        for m in filter(None, messages):
            store.move(m.unfinished, m.name)
        for file in old:
            store.delete_file(file)

    def abort(self, messages: list[Written | None]) -> None:
        store = store_of(self.path)[0]
        for m in filter(None, messages):
            if store.get_file_info(m.unfinished).type == stores.FileType.File:
                store.delete_file(m.unfinished)
