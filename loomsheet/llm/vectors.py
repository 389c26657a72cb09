"""Vector codes: each vector in parts, each part by its nearest entry of a trained codebook.

The nearest entry is found by equal-average search. The entries are ordered by the sum of their
components; from a part's own sum the search goes outward on both sides, and ends on a side as soon as the
squared gap of the sums, over the number of components, exceeds the best squared distance so far: no
entry further out can be as near. Parts are taken in the order of their sums, in tiles that share a
window of entries, so that distances are products of small matrices. A tile goes on while any of its parts
needs the next entries. All numbers are integers and the products exact: in doubles while no sum can
reach 2**53, beyond in Python's integers.

A round of training is one job: each task adds up its parts by entry, and the sums of tasks are added in
Spark. Only the codebooks come to the driver, 256 entries for each part position.

Defined results: vectors that are null, empty, or hold a null, a NaN or an infinity are dropped; so are those
that can't be cut into equal parts or differ in length from the seeds' first; equal distances take the
lower index; entries that no part takes stay; equal ids are ordered by their vectors when seeds are drawn;
rows without an id are coded, and seed only where others don't suffice; fewer vectors than entries
make smaller codebooks; an empty table gives no rows; extra columns are dropped. Errors that a long
can't hold raise an OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, bounded

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
TILE, STEP = 128, 16  # parts that share a window; entries that it grows by on a side
ROWS = 8192  # vectors that are assigned together
EXACT, LARGEST, FAR = 2**53, 2**63, 2**200
HOT = 100_000  # rows of a label from which its sum is broadcast


def _cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a list column that are whole and finite, their lengths, and all their components."""
    flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(sizes) - sizes
    bad = np.add.reduceat(np.append(~np.isfinite(values), False).astype(np.int64), np.minimum(starts, len(values))) if len(sizes) else np.zeros(0)
    good = np.flatnonzero((sizes > 0) & (np.where(sizes > 0, bad, 1) == 0))
    return good, sizes, values


def prepared(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, size, v: the kept rows; v has the scaled components as little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, sizes, values = _cells(batch.column("embedding"))
            good = good[sizes[good] % parts == 0]
            starts = (np.cumsum(sizes) - sizes)[good]
            scaled = np.floor(values * SCALE) if len(values) else values
            if len(good) and max(np.abs(scaled[a : a + n]).max() for a, n in zip(starts, sizes[good], strict=True)) >= LARGEST:
                raise OverflowError("a component, scaled, is beyond a long")
            data = [scaled[a : a + n].astype("<i8").tobytes() for a, n in zip(starts.tolist(), sizes[good].tolist(), strict=True)]
            rows = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("label").take(rows), pa.array(sizes[good].astype(np.int32)), pa.array(data, pa.binary())], ["vec_id", "label", "size", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return bounded(rows).mapInArrow(run, "vec_id long, label string, size int, v binary")


class Book:
    """The entries of one part position, ordered by sum."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.width = entries, entries.shape[1]
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.sorted = sums[self.order], entries[self.order]
        self.squares = (self.sorted * self.sorted).sum(axis=1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each part, and the squared distance."""
        own = parts.sum(axis=1)
        by_sum = np.argsort(own, kind="stable")
        index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
        for at in range(0, len(parts), TILE):
            rows = by_sum[at : at + TILE]
            index[rows], error[rows] = self._tile(parts[rows], own[rows])
        return index, error

    def _tile(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        squares, many = (x * x).sum(axis=1), len(self.sums)
        best, index = np.full(len(x), np.inf if x.dtype != object else FAR, x.dtype), np.full(len(x), many)

        def look(a: int, b: int) -> None:
            nonlocal best, index
            far = squares[:, None] - 2 * (x @ self.sorted[a:b].T) + self.squares[a:b]
            least = far.min(axis=1)
            # Of the nearest in the window, the lowest index; it beats an equal one found before if it is lower still.
            lowest = np.where(far == least[:, None], self.order[a:b], many).min(axis=1)
            index = np.where(least < best, lowest, np.where(least == best, np.minimum(index, lowest), index))
            best = np.minimum(best, least)

        def open_(end: int) -> bool:
            gap = own - self.sums[end]
            return bool((gap * gap <= self.width * best).any())

        middle = int(np.searchsorted(self.sums, own[len(own) // 2]))
        low, high = max(0, middle - STEP), min(many, middle + STEP)
        # The window has the sums of all parts of the tile, so that outside it gaps only grow.
        low, high = min(low, int(np.searchsorted(self.sums, own[0]))), max(high, int(np.searchsorted(self.sums, own[-1], side="right")))
        look(low, high)
        while low > 0 and open_(low - 1):
            look(max(0, low - STEP), low)
            low = max(0, low - STEP)
        while high < many and open_(high):
            look(high, min(many, high + STEP))
            high = min(many, high + STEP)
        return index, best


def _kind(v: np.ndarray, books: list[np.ndarray]):
    """The numbers in which all distances are exact."""
    most = max([int(np.abs(v).max(initial=0)), *(int(np.abs(b).max(initial=0)) for b in books)])
    width = books[0].shape[1]
    return np.float64 if 4 * max(1, width) ** 2 * (most + 1) ** 2 < EXACT else object


def _blocks(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int) -> Iterator[tuple]:
    """Pieces of batches with vectors of the right length: piece, vectors, and for each part indexes and distances."""
    made: dict = {}
    for batch in batches:
        batch = batch.filter(pc.equal(batch.column("size"), width))
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            v = np.frombuffer(b"".join(piece.column("v").to_pylist()), "<i8").reshape(-1, width)
            kind = _kind(v, books)
            own = made.setdefault(kind, [Book(b.astype(kind)) for b in books])
            x = v.astype(kind).reshape(len(v), len(books), -1)
            yield piece, v, [b.nearest(np.ascontiguousarray(x[:, k])) for k, b in enumerate(own)]


def seeds(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The first codebooks, one for each part position: the parts of the vectors with the smallest ids."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v"), F.col("size")]
    first = rows.select("vec_id", "v", "size").orderBy(*order).first()
    if first is None:
        return []
    width = first["size"]
    chosen = rows.where(F.col("size") == width).select("vec_id", "v", "size").orderBy(*order).limit(entries).collect()  # ``entries`` rows
    held = np.stack([np.frombuffer(r["v"], "<i8") for r in chosen])
    return np.split(held, parts, axis=1)


def improved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of its parts."""
    width, part = sum(b.shape[1] for b in books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), part), object) for b in books]
        for _, v, found in _blocks(batches, books, width):
            for k, (index, _) in enumerate(found):
                own = v[:, k * part : (k + 1) * part]
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                small = int(np.abs(own).max(initial=0)) * len(own) < LARGEST
                sums[k][used] += np.add.reduceat((own if small else own.astype(object))[order], starts, axis=0).astype(object)
                counts[k] += np.bincount(index, minlength=len(counts[k]))
        cells = [(k, int(e), int(counts[k][e]), [str(x) for x in sums[k][e]]) for k in range(len(books)) for e in np.flatnonzero(counts[k])]
        if cells:
            columns = list(zip(*cells, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.string()))], ["part", "entry", "many", "sums"])

    found = rows.select("size", "v").mapInArrow(run, "part int, entry int, many long, sums array<string>")
    # Sums are added as decimals, which hold what a long might not.
    added = found.groupBy("part", "entry").agg(F.sum("many").alias("many"), *[F.sum(F.col("sums")[k].cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(part)])
    out = [b.copy() for b in books]
    for r in added.collect():  # a row for each entry
        out[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["many"] for k in range(part)]
    return out


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of prepared rows; empty if there are none."""
    books = seeds(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(rows, books)
    return books


def codes(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error."""
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, found in _blocks(batches, books, width):
            hexes = np.stack([index for index, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = sum(e.astype(object) for _, e in found)
            if max(error) >= LARGEST:
                raise OverflowError("an error is beyond a long")
            step = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("label"), pa.array([hexes[i : i + step] for i in range(0, len(hexes), step)]), pa.array([int(e) for e in error], pa.int64())], ["vec_id", "label", "code", "error"]
            )

    return rows.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row of vec_id, embedding, label."""
    spark = vectors.sparkSession
    keep = Tables(spark)
    rows = keep(prepared(vectors, parts), "vectors")
    books = train(rows, parts, entries, rounds)
    if not books:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = keep(codes(rows, books), "codes")
    keep.drop("vectors")
    # Labels are told apart from a missing one; those of many rows, few by their nature, are joined by a broadcast, the others by a shuffle.
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = keep(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("many")), "labels")
    large = F.broadcast(sums.where(F.col("many") > HOT).select("key", F.col("label_error").alias("of_large")))
    held = keyed.join(large, "key", "left").withColumn("rare", F.when(F.col("of_large").isNull(), F.col("key")))
    rare = sums.where(F.col("many") <= HOT).select(F.col("key").alias("rare"), F.col("label_error").alias("of_rare"))
    common = held.where("rare IS NULL").withColumn("of_rare", F.lit(None).cast("long"))
    out = common.select("vec_id", "code", "error", "of_large", "of_rare").unionByName(held.where("rare IS NOT NULL").join(rare, "rare").select("vec_id", "code", "error", "of_large", "of_rare"))
    return out.select("vec_id", "code", "error", F.coalesce("of_large", "of_rare").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
