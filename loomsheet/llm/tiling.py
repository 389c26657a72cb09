"""Benchmark decontamination by greedy string tiling.

Texts are words without ASCII punctuation, in lower case. Windows of ``SEED`` words, hashed as they
run along (Karp-Rabin), are the seeds. Seeds on one diagonal grow into maximal matches. The longest
match of a document and an item becomes a tile, its words on both sides are marked, what is left of
the other matches is cut down to unmarked words, and so on until no match of the least length
remains. Tiles don't overlap and may stand in any order, so a passage whose sentences were moved is
still covered. An item is leaked into a document if tiles cover ``COVERAGE`` of its words.

The items' seeds are a table. A bitmap of them, of at most ``BITS`` bits however large the benchmark
is, goes to all tasks; the documents are read once, and only the windows that the bitmap lets through
are written. Those are joined to the seeds to find pairs of a text and an item. A pair that reaches the
coverage has tiles on at least COVERAGE * words / SEED of an item's windows, so as many less one, those
that most items hold, needn't find pairs: a stock phrase of all items joins nothing by itself. Texts
are known by their hashes, and copies are tiled once. Last, each pair is tiled by itself, and the
documents get the results of their texts.

Defined results: null and empty texts leak nothing; items without words match nothing; an item with
fewer words than ``SEED`` must occur whole; a repeated item counts once; repeated documents are each
reported; extra columns are dropped by ``leaks`` and kept by ``drop_leaks``. Very repetitive texts
are tiled like others: seeds are made in blocks of ``SEEDS`` and kept only as maximal matches.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as sh
from .common import Tables, bounded, slices, text_of, utf8

SEED = 5
COVERAGE = 0.5
BLOCK = 500_000  # bytes of text hashed together
BITS, SPARSE = 2**27, 256  # bits of the bitmap of seeds: 16 MB at most, and SPARSE for each seed where they fit
SEEDS = 2_000_000  # pairs of places looked at together
LISTED = 4_000_000  # texts (a few longs each) whose leaks may be broadcast

_BARE = np.arange(256, dtype=np.uint8)
_BARE[[c for c in range(33, 128) if not chr(c).isalnum()]] = 32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = utf8(column)
    return sh.words(_BARE[raw], offsets)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each place on."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    by, out = sh.series(n, 41), np.full(total, n, np.uint64)
    for j in range(n):
        out += hashes[j : j + total] * by[j]
    return sh.mix(out)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _list(arrays: list[np.ndarray], kind: type) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *arrays])))


def _merged(diagonals: np.ndarray, items: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches that continue one another on a diagonal, as one each."""
    order = np.lexsort((items, diagonals))
    d, i, k = diagonals[order], items[order], lengths[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + k[:-1])]))
    return d[first], i[first], np.add.reduceat(k, first)


def matches(item: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches (item place, document place, number of windows) of an item's windows and some of a document's."""
    by_hash = np.argsort(item, kind="stable")
    known = item[by_hash]
    lo, hi = np.searchsorted(known, hashes), np.searchsorted(known, hashes, side="right")
    hit = hi > lo
    places, lo, many = places[hit].astype(np.int64), lo[hit], (hi - lo)[hit]
    found = [(np.zeros(0, np.int64),) * 3]
    upto = np.cumsum(many)
    start = 0
    while start < len(places):
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + SEEDS, side="right")))
        n = many[start:stop]
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i = by_hash[np.repeat(lo[start:stop], n) + offset]
        found.append(_merged(np.repeat(places[start:stop], n) - i, i, np.ones(len(i), np.int64)))
        start = stop
    d, i, k = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(d):
        d, i, k = _merged(d, i, k)
    return i, i + d, k


def tile(found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, size: int) -> list[tuple[int, int, int]]:
    """Tiles (item place, document place, words) from maximal matches of windows of ``n`` words with an item of ``size`` words."""
    i, j, k = found
    if not len(i):
        return []
    low = int(j.min())
    heap = list(zip((1 - n - k).tolist(), i.tolist(), (j - low).tolist(), strict=True))
    heapq.heapify(heap)
    of_item, of_doc = np.zeros(size, bool), np.zeros(int((j + k).max()) - low + n, bool)
    tiles, left = [], size
    while heap and left >= n:
        length, a, b = heapq.heappop(heap)
        taken = of_item[a : a - length] | of_doc[b : b - length]
        if not taken.any():
            tiles.append((a, b + low, -length))
            of_item[a : a - length] = of_doc[b : b - length] = True
            left += length
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= n:
                heapq.heappush(heap, (start - end, a + start, b + start))
    return tiles


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (its key), item_id, size in words, n (words of its windows), hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                hashes, ends = words(part.column("text"))
                sizes = np.diff(ends)
                n = np.minimum(sizes, SEED)
                made = [windows(hashes[a:b], int(k)) if k else hashes[:0] for a, b, k in zip(ends[:-1], ends[1:], n, strict=True)]
                lists = _list(made, np.uint64)
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values.view(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("item"), part.column("item_id"), pa.array(sizes.astype(np.int32)), pa.array(n.astype(np.int32)), lists], ["item", "item_id", "size", "n", "hashes"])

    held = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("item_id IS NOT NULL").distinct()
    held = held.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return bounded(held).mapInArrow(run, "item long, item_id long, size int, n int, hashes array<long>").where("size > 0")


def finders(items: DataFrame, coverage: float) -> DataFrame:
    """(h, item): the windows that find pairs, the rarest of each item."""
    spare = F.greatest(F.ceil(F.lit(coverage) * F.col("size") / F.col("n")) - 1, F.lit(0))
    places = items.select("item", spare.alias("spare"), F.posexplode("hashes").alias("at", "h"))
    many = places.select("h", "item").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("many"))
    ranked = places.join(many, "h").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("many"), "at")))
    return ranked.where("rank > spare").select("h", "item").distinct()


def bitmap(items: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of the seeds' hashes; a row comes to the driver for every 32768 bits."""
    seeds = items.select(F.explode("hashes").alias("h"))
    bits = min(BITS, max(2**16, 2 ** math.ceil(math.log2(SPARSE * max(1, seeds.count())))))
    value = F.pmod(F.col("h"), F.lit(bits)) + 1
    rows = seeds.groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _key():
    return F.xxhash64(text_of())


def hits(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """key, n, places, hashes: the windows of a text that the bitmap lets through, once in a task for equal texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, set()
        low = np.uint64(len(known) * 8 - 1)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                keys = part.column("key").to_pylist()
                hashes, ends = words(part.column("text"))
                out: tuple[list, list, list, list] = ([], [], [], [])
                new = set()
                for n in lengths:
                    rolled = windows(hashes, n)
                    at = rolled & low
                    found = np.flatnonzero((known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                    rows = np.searchsorted(ends, found, side="right") - 1
                    inside = found + n <= ends[rows + 1]
                    found, rows = found[inside], rows[inside]
                    edges = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1], [True]])) if len(rows) else []
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        row = int(rows[a])
                        if keys[row] in seen or (keys[row], n) in new:
                            continue
                        new.add((keys[row], n))
                        for column, value in zip(out, (keys[row], n, (found[a:b] - ends[row]).astype(np.int32), rolled[found[a:b]]), strict=True):
                            column.append(value)
                seen.update(k for k, _ in new)
                lists = _list(out[3], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), _list(out[2], np.int32), pa.ListArray.from_arrays(lists.offsets, lists.values.view(pa.int64()))], ["key", "n", "places", "hashes"]
                )

    return bounded(docs.select(_key().alias("key"), text_of().alias("text"))).mapInArrow(run, "key long, n int, places array<int>, hashes array<long>")


def _slices_of(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


TILED = "key long, item_id long, n_tiles long, n_matched long, longest long, coverage double"


def tiled(pairs: DataFrame, coverage: float) -> DataFrame:
    """key, item_id and the measures of each pair (key, item_id, size, n, item, places, hashes) that reaches the coverage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            columns = [batch.column(c).to_pylist() for c in ("key", "item_id", "size", "n")] + [_slices_of(batch.column(c)) for c in ("item", "places", "hashes")]
            for key, item_id, size, n, item, places, hashes in zip(*columns, strict=True):
                covered = np.zeros(size + 1, np.int64)  # by all seeds; no tiling can cover more
                at = np.flatnonzero(np.isin(item, hashes))
                np.add.at(covered, at, 1)
                np.add.at(covered, at + n, -1)
                if np.count_nonzero(np.cumsum(covered)[:size]) < coverage * size:
                    continue
                lengths = [t[2] for t in tile(matches(item, places, hashes), n, size)]
                if sum(lengths) >= coverage * size:
                    made.append((key, item_id, len(lengths), sum(lengths), max(lengths), sum(lengths) / size))
            columns = list(zip(*made, strict=True)) if made else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(columns)], [x.split()[0] for x in TILED.split(", ")])

    return bounded(pairs).mapInArrow(run, TILED)


def leaked_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """key (the hash of a text), item_id, n_tiles, n_matched, longest, coverage, once for each text; a written table."""
    keep = Tables(docs.sparkSession)
    items = keep(items_of(benchmark), "items")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # SEED values at most
    found = keep(hits(docs, lengths, bitmap(items)), "hits")
    once = found.dropDuplicates(["key", "n"])
    pairs = keep(once.select("key", F.explode(F.array_distinct("hashes")).alias("h")).join(finders(items, coverage), "h").select("key", "item").distinct(), "pairs")
    held = items.select("item", "item_id", "size", "n", F.col("hashes").alias("own"))
    joined = pairs.join(held, "item").join(once, ["key", "n"])
    out = keep(tiled(joined.select("key", "item_id", "size", "n", F.col("own").alias("item"), "places", "hashes"), coverage), "leaks")
    keep.drop_all("leaks")
    return out


def _known(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= LISTED else df


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_tiles, n_matched, longest, coverage: a row for each document and item leaked into it."""
    found = leaked_texts(docs, benchmark, coverage)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key")).join(_known(found), "key").drop("key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` into which no item is leaked."""
    gone = leaked_texts(docs, benchmark, coverage).select(F.col("key").alias("__key")).distinct()
    return docs.join(_known(gone), _key() == F.col("__key"), "left_anti")
