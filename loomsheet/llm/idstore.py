"""Token ids as binary shards, with a minimal perfect hash index for access by key.

``write`` orders documents by doc_id, encodes them and writes two kinds of files through Spark's own
writer, so that lost executors, attempts and any file system are its concern:

* ``ids/``: a shard is a header, the raw little-endian ids of its documents, and a table of these
  documents. A shard has about ``shard_bytes`` of ids or ``MOST_DOCS`` documents, and never less than one document.
* ``index/part=k/``: keys are dealt to parts by a hash. A part has a minimal perfect hash function: each
  level is a bitmap in which the keys that no other key meets have their bit; the others go on to the
  next level; a bit's rank, from a directory of counted bits, is its slot. A slot holds the key's fingerprint,
  shard, offset and length.
* ``shards/``, ``keys/``: Parquet tables of the shards, with how many ids lie before each and its file, and of the keys.

A key is (doc_id, copy): rows that share a doc_id are numbered from 0. ``lookup`` finds keys through the
index, ``read`` fetches ids at what was found, both as Spark jobs; ``Reader`` gets one key by reading
one slot and one run of ids. A key that isn't there meets a stranger's fingerprint once in 2**32.

Defined results: null and empty texts give the end id alone; a null doc_id comes first and is a key
too; rows that share a doc_id, equal or not, keep the order in which they were read; very long texts
make a shard of their own; an empty table gives no shard and finds nothing; extra columns are dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import bytes_under
from .common import bounded, slices, text_of, written

END = 2
SHARD_BYTES = 8 << 20
MOST_DOCS = 1 << 16
TASK_BYTES = 64 << 20  # of text that a task orders and encodes
KEYS = 1 << 16  # of a part of the index
FEWEST = 64  # tasks and parts
LEVELS, ROOM = 24, 2  # of the hash function: levels, bits for each key on a level
HEAD = "<4sIQQQQ"  # magic, bytes of an id, ids, documents, range, place in the range
ENTRY = np.dtype([("doc_id", "<i8"), ("copy", "<i8"), ("n", "<u8")])
PART = "<4sIQII"  # magic, part, keys, levels, keys without a bit
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])
LINE = b"\n"  # what Spark's writer puts after a file's only row


def key_columns(doc_id: Column, copy: Column) -> tuple[Column, Column]:
    """A key as two longs that are never null: a null doc_id is 0 with a copy below 0."""
    return F.coalesce(doc_id, F.lit(0)).cast("long"), F.when(doc_id.isNull(), -1 - copy).otherwise(copy).cast("long")


def part_of(doc_id: Column, copy: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, copy), F.lit(parts)).cast("int")


def _hashed(text: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(text, seed)


# --- the hash function -------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(doc_id.astype(np.int64).view(np.uint64) + _mixed(copy.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _at(folded: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(folded + np.uint64((level + 1) * 0xD6E8FEB86659FD93 % 2**64)) % np.uint64(size)).astype(np.int64)


def _prints(folded: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(folded ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Keys to 0 .. n - 1, without gaps; other keys to -1 or to any of these."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])  # bits set before each byte
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    @classmethod
    def build(cls, doc_id: np.ndarray, copy: np.ndarray) -> PerfectHash:
        folded, left = _folded(doc_id, copy), np.arange(len(doc_id))
        sizes, maps = [], []
        while len(left) and len(sizes) < LEVELS:
            size = -(-ROOM * len(left) // 64) * 64
            at = _at(folded[left], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            maps.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        rest = np.stack([doc_id[left], copy[left]], axis=1).astype("<i8")
        return cls(np.array(sizes, "<u4"), np.concatenate(maps) if maps else np.zeros(0, np.uint8), rest)

    def slots(self, doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
        folded, out = _folded(doc_id, copy), np.full(len(doc_id), -1, np.int64)
        open_ = np.arange(len(doc_id))
        for level, size in enumerate(self.sizes.tolist()):
            at = _at(folded[open_], level, size) + self.starts[level]
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            inside = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = (self.before[at >> 3] + inside)[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        if len(self.rest) and len(open_):
            known = {tuple(k): i for i, k in enumerate(self.rest.tolist())}
            for k in open_.tolist():
                if (i := known.get((int(doc_id[k]), int(copy[k])))) is not None:
                    out[k] = int(self.before[-1]) + i
        return out

    def dump(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.sizes.astype("<u4"), self.bits, self.rest.astype("<i8")))

    @classmethod
    def load(cls, data: memoryview, levels: int, rest: int) -> tuple[PerfectHash, int]:
        sizes = np.frombuffer(data, "<u4", levels)
        many = int(sizes.astype(np.int64).sum()) // 8
        bits = np.frombuffer(data, np.uint8, many, 4 * levels)
        at = 4 * levels + many
        return cls(sizes, bits, np.frombuffer(data, "<i8", 2 * rest, at).reshape(-1, 2)), at + 16 * rest


# --- writing -----------------------------------------------------------------------------------


def _binary_rows(df: DataFrame, path: str, *by: str) -> None:
    """A file for each row of ``data``: its bytes, and a line end that readers pass over."""
    df.select(*by, F.col("data").cast("string").alias("value")).write.partitionBy(*by).option("maxRecordsPerFile", 1).text(path)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> None:
    """Encodes doc_id, text with the library's tokenizer file and writes ``ids``, ``shards`` and ``index`` under ``path``."""
    write_ids(docs, path, tokenizer, end, shard_bytes)
    write_index(docs.sparkSession, path)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> None:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("place"))
    sizes = docs.agg(F.sum(F.octet_length(text_of()).cast("long"))).first()[0] or 0
    tasks = max(FEWEST, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes // TASK_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        own, number, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        last, copy = (), 0  # the key before, and how often it came
        held: list[bytes] = []
        table: list[tuple[int, int, int]] = []
        size = 0
        stop = np.array([end], own.kind).tobytes()

        def shard() -> pa.RecordBatch:
            entries = np.array(table, ENTRY)
            head = struct.pack(HEAD, b"IDS1", own.kind.itemsize, int(entries["n"].sum()), len(entries), number, place)
            return pa.RecordBatch.from_arrays([pa.array([b"".join([head, *held, entries.tobytes()])], pa.binary())], ["data"])

        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text")), strict=True):
                    copy = copy + 1 if (doc_id,) == last else 0
                    last = (doc_id,)
                    held += ids, stop
                    size += len(ids) + len(stop)
                    table.append((0, -1 - copy, (len(ids) + len(stop)) // own.kind.itemsize) if doc_id is None else (doc_id, copy, (len(ids) + len(stop)) // own.kind.itemsize))
                    if size >= shard_bytes or len(table) >= MOST_DOCS:
                        yield shard()
                        held, table, size, place = [], [], 0, place + 1
        if table:
            yield shard()

    shards = bounded(ordered, "8m").mapInArrow(run, "data binary")
    _binary_rows(shards, f"{path}/ids")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 1").select("path", "content")


def _shard(content) -> tuple[np.ndarray, np.ndarray, int, int]:
    """ids, documents, range and place of a shard file."""
    magic, width, ids, many, number, place = struct.unpack_from(HEAD, content)
    if magic != b"IDS1":
        raise ValueError("not a shard of ids")
    flat = np.frombuffer(content, f"<u{width}", ids, struct.calcsize(HEAD))
    return flat, np.frombuffer(content, ENTRY, many, struct.calcsize(HEAD) + width * ids), number, place


def entries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, copy (a key as two longs), range, place, offset, n, file: the documents as the shards list them; copies are counted within a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                _, table, number, place = _shard(content.as_buffer())
                n = table["n"].astype(np.int64)
                same = lambda x, kind: pa.array(np.full(len(table), x), kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table["doc_id"]), pa.array(table["copy"]), same(number, pa.int64()), same(place, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([file] * len(table), pa.string())],
                    ["doc_id", "copy", "range", "place", "offset", "n", "file"],
                )

    return bounded(_files(spark, f"{path}/ids"), "8m").mapInArrow(run, "doc_id long, copy long, range long, place long, offset long, n long, file string")


def write_index(spark: SparkSession, path: str) -> None:
    """Reads the shards' own tables and writes the table of shards and the parts of the index."""
    listed = written(entries(spark, path), "entries")
    # What each range of the order holds: a row for each task that wrote, at most.
    null = F.col("copy") < 0
    turn = F.when(null, -1 - F.col("copy")).otherwise(F.col("copy"))
    key = F.struct((~null).alias("known"), F.col("doc_id").alias("doc_id"))
    ranges = listed.groupBy("range").agg(F.sum("n").alias("ids"), F.min(key).alias("first"), F.max(key).alias("last"), F.max(F.struct(key.alias("key"), turn.alias("turn")))["turn"].alias("turn")).orderBy("range").collect()
    before, carried, at, known, copies = [], [], 0, None, 0
    for r in ranges:
        before.append((r["range"], at))
        first, last = tuple(r["first"]), tuple(r["last"])
        have = copies if first == known else 0
        carried.append((r["range"], first[0], first[1], have))
        copies, known, at = r["turn"] + 1 + (have if last == first else 0), last, at + r["ids"]
    starts = spark.createDataFrame(before, "range long, base long")
    shards = listed.groupBy("range", "place", "file").agg(F.sum("n").alias("ids"))
    inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    numbered = shards.withColumn("inside", F.sum("ids").over(inside) - F.col("ids")).withColumn("nth", F.row_number().over(inside))
    many = {r["range"]: r["many"] for r in numbered.groupBy("range").agg(F.count(F.lit(1)).alias("many")).collect()}  # a row for each range
    firsts, at = [], 0
    for k in sorted(many):
        firsts.append((k, at))
        at += many[k]
    starts = starts.join(spark.createDataFrame(firsts, "range long, first long"), "range")
    placed = numbered.join(F.broadcast(starts), "range").select((F.col("first") + F.col("nth") - 1).alias("shard"), (F.col("base") + F.col("inside")).alias("start"), "ids", "range", "place", "file")
    placed.write.parquet(f"{path}/shards")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/shards")

    moved = [c for c in carried if c[3]]
    rows = listed.join(placed.select("range", "place", "shard"), ["range", "place"])
    if moved:
        more = F.broadcast(spark.createDataFrame(moved, "range long, known boolean, doc_id long, have long"))  # a row for each range
        same = (rows["range"] == more["range"]) & (rows["doc_id"] == more["doc_id"]) & ((rows["copy"] >= 0) == more["known"])
        rows = rows.join(more, same, "left").select(rows["doc_id"], (rows["copy"] + F.coalesce(F.when(rows["copy"] < 0, -more["have"]).otherwise(more["have"]), F.lit(0))).alias("copy"), rows["shard"], rows["offset"], rows["n"])
    parts = max(FEWEST, -(-listed.count() // KEYS))
    rows.select("doc_id", "copy").write.parquet(f"{path}/keys")
    keyed = rows.select(part_of(F.col("doc_id"), F.col("copy"), parts).alias("part"), "doc_id", "copy", "shard", "offset", "n")

    def build(table: pa.Table) -> pa.Table:
        doc_id, copy = table["doc_id"].to_numpy(), table["copy"].to_numpy()
        own = PerfectHash.build(doc_id, copy)
        slots = np.zeros(len(doc_id), SLOT)
        at = own.slots(doc_id, copy)
        slots["print"][at] = _prints(_folded(doc_id, copy))
        slots["shard"][at], slots["offset"][at], slots["n"][at] = table["shard"].to_numpy(), table["offset"].to_numpy(), table["n"].to_numpy()
        head = struct.pack(PART, b"MPH1", table["part"][0].as_py(), len(doc_id), len(own.sizes), len(own.rest))
        return pa.table({"part": table["part"].slice(0, 1), "data": pa.array([head + own.dump() + slots.tobytes()], pa.binary())})

    _binary_rows(keyed.groupBy("part").applyInArrow(build, "part int, data binary"), f"{path}/index", "part")
    spark.createDataFrame([(parts,)], "parts int").coalesce(1).write.parquet(f"{path}/made")


# --- reading -----------------------------------------------------------------------------------


def keys(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, copy: all keys, as two longs."""
    return spark.read.schema("doc_id long, copy long").parquet(f"{path}/keys")


def parts_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/made").first()["parts"]


def found_in(content, doc_id: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a part of the index has each key, and the slots (of any content where it hasn't)."""
    magic, _, many, levels, rest = struct.unpack_from(PART, content)
    if magic != b"MPH1":
        raise ValueError("not a part of an index")
    own, size = PerfectHash.load(memoryview(content)[struct.calcsize(PART) :], levels, rest)
    slots = np.frombuffer(content, SLOT, many, struct.calcsize(PART) + size)
    at = own.slots(doc_id, copy)
    held = slots[np.maximum(at, 0)] if many else np.zeros(len(doc_id), SLOT)
    return (at >= 0) & (held["print"] == _prints(_folded(doc_id, copy))), held


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """doc_id, copy (a key as two longs), shard, offset, n of the keys that the index has."""
    spark = keys.sparkSession
    parts = parts_of(spark, path)
    asked = keys.select(part_of(F.col("doc_id"), F.col("copy"), parts).alias("part"), "doc_id", "copy")
    files = _files(spark, f"{path}/index").select(F.regexp_extract("path", r"/part=(\d+)/", 1).cast("int").alias("part"), "content")

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        doc_id, copy = want["doc_id"].to_numpy(), want["copy"].to_numpy()
        if not have.num_rows or not len(doc_id):
            there, held = np.zeros(len(doc_id), bool), np.zeros(len(doc_id), SLOT)
        else:
            there, held = found_in(have["content"][0].as_buffer(), doc_id, copy)
        cell = lambda c: pa.array(held[c][there].astype(np.int64))
        return pa.table({"doc_id": pa.array(doc_id[there]), "copy": pa.array(copy[there]), "shard": cell("shard"), "offset": cell("offset"), "n": cell("n")})

    return files.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(run, "doc_id long, copy long, shard long, offset long, n long")


def read(spark: SparkSession, located: DataFrame, path: str, made: Callable[[list[np.ndarray]], pa.Array], kind: str) -> DataFrame:
    """doc_id (null again where it was), copy, start, n_tokens, value: ``made`` of a shard's ids cut at what ``lookup`` located; ``kind`` is Spark's type of it."""
    held = spark.read.parquet(f"{path}/shards")
    files = _files(spark, f"{path}/ids").join(F.broadcast(held.select(F.col("file").alias("path"), "shard", "start")) if bytes_under(spark, f"{path}/shards") < 8 << 20 else held.select(F.col("file").alias("path"), "shard", "start"), "path").select("shard", "start", "content")

    def run(have: pa.Table, want: pa.Table) -> pa.Table:
        if not have.num_rows:
            raise ValueError("the index names a shard that isn't there")
        ids = _shard(have["content"][0].as_buffer())[0]
        at, n = want["offset"].to_numpy(), want["n"].to_numpy()
        return pa.table({
            "doc_id": want["doc_id"], "copy": want["copy"],
            "start": pa.array(at + have["start"][0].as_py(), pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "value": made([ids[a : a + k] for a, k in zip(at.tolist(), n.tolist(), strict=True)]),
        })

    cut = files.groupBy("shard").cogroup(located.groupBy("shard")).applyInArrow(run, f"doc_id long, copy long, start long, n_tokens long, value {kind}")
    return cut.select(F.when(F.col("copy") >= 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("copy") >= 0, F.col("copy")).otherwise(-1 - F.col("copy")).alias("copy"), "start", "n_tokens", "value")


def crcs(runs: list[np.ndarray]) -> pa.Array:
    """crc32 of each run of ids as little-endian 32-bit integers."""
    return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in runs], pa.int64())


def lists(runs: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype(np.int32) for x in runs], pa.list_(pa.int32()))


class Reader:
    """One key at a time, on the driver: reads a slot of the index and the ids that it names, through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.parts = spark, path, parts_of(spark, path)
        self.known: dict[int, tuple[str, PerfectHash, int]] = {}

    def _bytes(self, file: str, at: int, many: int) -> bytes:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        held = jvm.org.apache.hadoop.fs.Path(file)
        opened = held.getFileSystem(hadoop).open(held)
        try:
            opened.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(opened, many))
        finally:
            opened.close()

    def _part(self, k: int) -> tuple[str, PerfectHash, int] | None:
        if k not in self.known:
            jvm = self.spark._jvm
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/index/part={k}")
            system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            files = [f.getPath().toString() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-")] if system.exists(folder) else []
            if not files:
                return None
            _, _, _, levels, rest = struct.unpack(PART, self._bytes(files[0], 0, struct.calcsize(PART)))
            sizes = np.frombuffer(self._bytes(files[0], struct.calcsize(PART), 4 * levels), "<u4")
            size = 4 * levels + int(sizes.astype(np.int64).sum()) // 8 + 16 * rest
            self.known[k] = files[0], PerfectHash.load(memoryview(self._bytes(files[0], struct.calcsize(PART), size)), levels, rest)[0], struct.calcsize(PART) + size
        return self.known[k]

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of a document, or None."""
        a, b = (0, -1 - copy) if doc_id is None else (doc_id, copy)
        seed = _hashed(struct.pack("<q", a), 42)
        code = _hashed(struct.pack("<q", b), seed)
        held = self._part((code - 2**64 if code >= 2**63 else code) % self.parts)
        if held is None:
            return None
        file, own, base = held
        keys = np.array([a], np.int64), np.array([b], np.int64)
        at = int(own.slots(*keys)[0])
        if at < 0:
            return None
        slot = np.frombuffer(self._bytes(file, base + at * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
        if slot["print"] != _prints(_folded(*keys))[0]:
            return None
        shard = self.spark.read.parquet(f"{self.path}/shards").where(F.col("shard") == int(slot["shard"])).first()["file"]
        width = struct.unpack(HEAD, self._bytes(shard, 0, struct.calcsize(HEAD)))[1]
        return np.frombuffer(self._bytes(shard, struct.calcsize(HEAD) + int(slot["offset"]) * width, int(slot["n"]) * width), f"<u{width}")
