"""A Merkle manifest of a dataset: a hash for each document, a tree for each language, one root.

A leaf's place in its tree is its rank by doc_id. Ranks come from bitmaps, not from sorting documents: the
ids of each language and each ``CHUNK`` of the id axis become compressed containers in every batch (a list
of places, or words with a directory of counted bits), which are merged by key; directories of counts over
the id axis, in steps of at most 2**18 entries, say how many ids lie in earlier chunks. A rank is then a
directory entry and a count of bits, looked up by a join on the chunk. The levels are reduced two at a time: nodes are
keyed by tree and block of 64 and meet in one array, whose index is the slot.

Defined results: a null field is ``-``; null languages are a tree of their own, before the others; null
ids come first in their tree; rows of one tree that share an id, or have none, are ordered by leaf; equal
rows take places next to each other and each has its proof; an empty table has no root and gives no
rows; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rowid import number_rows
from ..sources.shared import bytes_under
from .common import Tables, bounded

BITS = 12
CHUNK = 1 << BITS  # ids that a container covers
LISTED = 128  # ids up to which a container is a list
SALTS = 16
STEP_BITS = (18, 35)  # of the chunk's number: what the two upper directories leave out
RUN, BLOCK = 8, 64  # children of a node; nodes that are reduced together, two levels
TOGETHER = 1 << 16  # equal rows that one row stands for
BROADCAST = 16 << 20

PIECE = "tree string, high long, piece struct<ids:binary,repeats:binary>"
REPEAT = np.dtype([("low", "<u2"), ("more", "<u8")])


def field(c: Column) -> Column:
    """A field of a leaf: ``-``, or its bytes' number, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def leaves(docs: DataFrame, *further: Column) -> DataFrame:
    """tree (a text that orders as the language does, null first), doc_id, leaf and ``further`` columns."""
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("."), F.col("lang").cast("string")))
    leaf = leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), *further)


# --- containers --------------------------------------------------------------------------------


def _packed(counts: np.ndarray) -> dict:
    """The container of a chunk in which ``counts[low]`` rows have the id ``low``."""
    low = np.flatnonzero(counts)
    again = low[counts[low] > 1]
    repeats = np.zeros(len(again), REPEAT)
    repeats["low"], repeats["more"] = again, counts[again] - 1
    ids = b"L" + low.astype("<u2").tobytes() if len(low) <= LISTED else b"B" + np.packbits(counts > 0, bitorder="little").tobytes()
    return {"ids": ids, "repeats": repeats.tobytes()}


def _counts(pieces: list[dict]) -> np.ndarray:
    """Merges containers."""
    counts = np.zeros(CHUNK, np.int64)
    for p in pieces:
        if p["ids"][:1] == b"L":
            counts[np.frombuffer(p["ids"], "<u2", offset=1)] += 1
        else:
            counts += np.unpackbits(np.frombuffer(p["ids"], np.uint8, offset=1), bitorder="little")
        repeats = np.frombuffer(p["repeats"], REPEAT)
        counts[repeats["low"]] += repeats["more"].astype(np.int64)
    return counts


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A container for each tree and chunk of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = batch.column("tree").dictionary_encode()
        tree, ids = trees.indices.to_numpy(), batch.column("doc_id").to_numpy()
        high = ids >> BITS
        order = np.lexsort((high, tree))
        tree, high, low = tree[order], high[order], (ids & (CHUNK - 1))[order]
        starts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (high[1:] != high[:-1])]))
        packed = [_packed(np.bincount(part, minlength=CHUNK)) for part in np.split(low, starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [trees.dictionary.take(pa.array(tree[starts])), pa.array(high[starts]), pa.array(packed, pa.struct([("ids", pa.binary()), ("repeats", pa.binary())]))],
            ["tree", "high", "piece"],
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_packed(_counts(p)) for p in batch.column("pieces").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("high"), pa.array(made, pa.struct([("ids", pa.binary()), ("repeats", pa.binary())]))], ["tree", "high", "piece"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last merge, in the form that ranks are looked up in."""
    kind = pa.struct([("low", pa.int32()), ("more", pa.int64())])
    for batch in batches:
        many, lows, words, before, repeats = [], [], [], [], []
        for pieces in batch.column("pieces").to_pylist():
            counts = _counts(pieces)
            low = np.flatnonzero(counts)
            again = low[counts[low] > 1]
            many.append(int(counts.sum()))
            repeats.append([{"low": int(k), "more": int(counts[k] - 1)} for k in again])
            if len(low) <= LISTED:
                lows.append(low.astype(np.int32))
                words.append(None)
                before.append(None)
            else:
                own = np.packbits(counts > 0, bitorder="little").view("<i8")
                ones = np.cumsum(np.bitwise_count(own.view(np.uint64)), dtype=np.int32)
                lows.append(None)
                words.append(own)
                before.append(np.concatenate([[0], ones[:-1]]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("high"), pa.array(many, pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int64())), pa.array(before, pa.list_(pa.int32())), pa.array(repeats, pa.list_(kind))],
            ["tree", "high", "many", "lows", "words", "before", "repeats"],
        )


def containers(rows: DataFrame) -> DataFrame:
    """tree, high, many, lows | words and before, repeats: a container for each chunk of each tree that has ids."""
    ids = rows.where(F.col("doc_id").isNotNull()).select("tree", "doc_id")
    pieces = bounded(ids).mapInArrow(_pieces, PIECE)
    # Many batches may meet in one chunk: they are merged in two steps.
    some = pieces.groupBy("tree", "high", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.collect_list("piece").alias("pieces"))
    some = some.select("tree", "high", "pieces").mapInArrow(_merged, PIECE)
    return some.groupBy("tree", "high").agg(F.collect_list("piece").alias("pieces")).mapInArrow(
        _opened, "tree string, high long, many long, lows array<int>, words array<long>, before array<int>, repeats array<struct<low:int,more:long>>"
    )


def _counted(df: DataFrame, parent: Column, key: str) -> DataFrame:
    """Adds start: what ``many`` sums to before this key under the same parent."""
    earlier = Window.partitionBy("tree", parent).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum("many").over(earlier), F.lit(0)))


def directory(held: DataFrame, without_id: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, high, base) of each chunk and (tree, n) of each tree; ``without_id`` has tree, none of rows that have no id."""
    low, up = STEP_BITS
    chunks = held.select("tree", "high", "many")
    middle = chunks.groupBy("tree", F.shiftright("high", low).alias("mid")).agg(F.sum("many").alias("many"))
    top = middle.groupBy("tree", F.shiftright("mid", up - low).alias("top")).agg(F.sum("many").alias("many"))
    trees = top.groupBy("tree").agg(F.sum("many").alias("many")).join(without_id, "tree", "full").select("tree", (F.coalesce("many", F.lit(0)) + F.coalesce("none", F.lit(0))).alias("n"), F.coalesce("none", F.lit(0)).alias("none"))
    at_top = _counted(top, F.lit(0), "top").join(trees, "tree").select("tree", "top", (F.col("start") + F.col("none")).alias("more"))
    at_middle = _counted(middle, F.shiftright("mid", up - low), "mid").withColumn("top", F.shiftright("mid", up - low)).join(at_top, ["tree", "top"]).select("tree", "mid", (F.col("start") + F.col("more")).alias("more"))
    bases = _counted(chunks, F.shiftright("high", low), "high").withColumn("mid", F.shiftright("high", low)).join(at_middle, ["tree", "mid"]).select("tree", "high", (F.col("start") + F.col("more")).alias("base"))
    return bases, trees.select("tree", "n")


def _running(df: DataFrame, order: list[str], value: str, keep: Tables) -> DataFrame:
    """Adds running: the sum of ``value`` over all earlier rows in the order, by ranges."""
    ranges = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = keep(df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("range").agg(F.sum(value).alias("own"))  # a row for each range
    sums = sums.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("base"))
    inside = F.sum(value).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return cut.withColumn("inside", inside).join(F.broadcast(sums), "range").withColumn("running", F.col("base") + F.col("inside")).drop("range", "inside", "base")


def coordinates(rows: DataFrame, keep: Tables) -> DataFrame:
    """Adds pos, the leaf's place in its tree, and n, the tree's leaves, to written rows with tree, doc_id, leaf."""
    names = rows.columns
    held = keep(containers(rows), "containers")
    none = rows.where(F.col("doc_id").isNull()).groupBy("tree").agg(F.count(F.lit(1)).alias("none"))
    bases, trees = directory(held, none)
    trees = keep(trees, "trees")
    held = keep(held.join(bases, ["tree", "high"]).join(trees, "tree").drop("many"), "ranks")
    keep.drop("containers")
    if bytes_under(rows.sparkSession, keep.paths["ranks"][0]) < BROADCAST:
        held = F.broadcast(held)
    low = (F.col("doc_id").bitwiseAND(F.lit(CHUNK - 1))).cast("int")
    found = rows.withColumn("high", F.shiftright("doc_id", BITS)).withColumn("low", low).join(held, ["tree", "high"])
    word = F.shiftright("low", 6)
    inside = F.when(F.col("words").isNull(), F.array_position("lows", F.col("low")) - 1).otherwise(F.get("before", word) + F.bit_count(F.get("words", word).bitwiseAND(F.expr("~shiftleft(-1L, low & 63)"))))
    more = F.aggregate(F.filter("repeats", lambda r: r["low"] < F.col("low")), F.lit(0).cast("long"), lambda a, r: a + r["more"])
    placed = found.withColumn("pos", F.col("base") + inside + more).withColumn("shared", F.exists("repeats", lambda r: r["low"] == F.col("low"))).select(*names, "pos", "n", "shared")
    placed = keep(placed, "placed")
    alone = placed.where("NOT shared").drop("shared")
    # Rows that share an id, or have none: as many places as there are equal rows, in the order of leaves.
    without = rows.where(F.col("doc_id").isNull()).join(trees, "tree").withColumn("pos", F.lit(0).cast("long"))
    shared = placed.where("shared").drop("shared").unionByName(without.select(*names, "pos", "n"))
    if shared.isEmpty():
        return alone
    same = keep(shared.groupBy("tree", "doc_id", "pos", "n", *[c for c in names if c not in ("tree", "doc_id")]).agg(F.count(F.lit(1)).alias("copies")), "same")
    order = [c for c in ("tree", "pos", "leaf", *names) if c != "doc_id"]
    summed = _running(same, list(dict.fromkeys(order)), "copies", keep)
    # The first of an id's rows is where its first leaf is.
    first = summed.groupBy("tree", "pos").agg(F.min("running").alias("first"))
    at = summed.join(first, ["tree", "pos"]).withColumn("pos", F.col("pos") + F.col("running") - F.col("first"))
    parts = at.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(TOGETHER).cast("long"))))
    spread = parts.repartition("tree", "pos", "part").withColumn("k", F.explode(F.sequence(F.col("part"), F.least(F.col("part") + TOGETHER, F.col("copies")) - 1)))
    return alone.unionByName(spread.withColumn("pos", F.col("pos") + F.col("k")).select(*names, "pos", "n"))


# --- levels ------------------------------------------------------------------------------------


def levels(n: Column) -> Column:
    """How often ``n`` nodes become an eighth of their number, rounded up, until one is left."""
    return sum((F.when(n > RUN**k, 1).otherwise(0) for k in range(21)), F.lit(0))


def _joined(a: Column) -> Column:
    return F.array_join(a, "")


def blocks(nodes: DataFrame) -> DataFrame:
    """A row for each tree and block of nodes with left > 0: slots (an array of node, by place), mids, hash, left of the node above."""
    nodes = nodes.where("left > 0")
    held = nodes.groupBy("tree", F.shiftright("pos", 6).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), *[F.col(c) for c in nodes.columns if c not in ("tree", "pos", "left")]))).alias("slots"), F.first("left").alias("left"))
    hashes = F.transform("slots", lambda s: s["hash"])
    runs = F.sequence(F.lit(0), F.shiftright(F.size("slots") - 1, 3))
    held = held.withColumn("mids", F.transform(runs, lambda k: F.sha2(_joined(F.slice(hashes, k * RUN + 1, RUN)).cast("binary"), 256)))
    above = F.when(F.col("left") == 1, F.get("mids", F.lit(0))).otherwise(F.sha2(_joined(F.col("mids")).cast("binary"), 256))
    return held.withColumn("hash", above)


def climb(nodes: DataFrame, most: int, keep: Tables, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and tree, hash, round of the roots. ``nodes`` has tree, pos, hash, left; ``most`` is the largest left."""
    rounds, roots = [], nodes.where("left = 0").select("tree", "hash", F.lit(0).alias("round"))
    for k in range(-(-most // 2)):
        made = keep(blocks(nodes), f"{name}-{k}")
        rounds.append(made)
        nodes = made.select("tree", "pos", "hash", F.greatest(F.col("left") - 2, F.lit(0)).alias("left"))
        roots = roots.unionByName(nodes.where("left = 0").select("tree", "hash", F.lit(k + 1).alias("round")))
    return rounds, roots


def descend(rounds: list[DataFrame], tops: DataFrame, keep: Tables, name: str) -> DataFrame:
    """For each node of the first round: its tree, slot and path. ``tops`` has tree, round, path and further columns of each root.

    A path is an array of what stands left and right of the node on each level, the lowest first.
    """
    further = [c for c in tops.columns if c not in ("tree", "round", "path")]
    below = None
    for k in range(len(rounds) - 1, -1, -1):
        above = tops.where(F.col("round") == k + 1).select("tree", F.lit(0).cast("long").alias("pos"), "path", *further)
        if below is not None:
            above = above.unionByName(below.select("tree", F.col("slot.at").alias("pos"), "path", *further))
        held = rounds[k].join(above, ["tree", "pos"])
        opened = held.select("tree", "path", "slots", "mids", "left", *further, F.posexplode("slots").alias("i", "slot"))
        hashes = F.transform("slots", lambda s: s["hash"])
        run = F.shiftright("i", 3)
        near = F.struct(_joined(F.slice(hashes, run * RUN + 1, F.col("i") - run * RUN)).alias("l"), _joined(F.slice(hashes, F.col("i") + 2, run * RUN + RUN - 1 - F.col("i"))).alias("r"))
        far = F.struct(_joined(F.slice("mids", F.lit(1), run)).alias("l"), _joined(F.slice("mids", run + 2, F.lit(RUN))).alias("r"))
        path = F.concat(F.when(F.col("left") == 1, F.array(near)).otherwise(F.array(near, far)), F.col("path"))
        below = opened.select("tree", "slot", path.alias("path"), *further)
        if k:
            below = keep(below, f"{name}-paths-{k}")
    return below


def siblings(path: Column) -> Column:
    """The hash of all that a path has, level by level."""
    return F.sha2(_joined(F.transform(path, lambda p: F.concat(p["l"], p["r"]))).cast("binary"), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]).cast("binary"), 256))


def manifest(rows: DataFrame) -> DataFrame:
    """rows (tree, doc_id, leaf and others), with subroot, root and path of each."""
    spark = rows.sparkSession
    keep = Tables(spark)
    others = [c for c in rows.columns if c not in ("tree", "leaf")]
    rows = keep(rows, "leaves")
    leafed = coordinates(rows, keep).withColumn("left", levels(F.col("n"))).withColumnRenamed("leaf", "hash").drop("n")
    leafed = keep(leafed, "nodes")
    most = leafed.agg(F.max("left")).first()[0]
    rounds, roots = climb(leafed, most or 0, keep, "tree")
    roots = keep(roots, "roots")
    # The roots of the trees are the leaves of one more tree.
    listed = number_rows(roots.select("tree"), ["tree"], "pos")
    count = roots.count()
    forest = keep(roots.join(listed, "tree").select(F.lit("").alias("tree"), "pos", "hash", F.col("tree").alias("of"), "round").withColumn("left", levels(F.lit(count))), "forest")
    upper, top = climb(forest.select("tree", "pos", "hash", "of", "round", "left"), forest.agg(F.max("left")).first()[0] or 0, keep, "forest")
    root = (top.first() or {"hash": None})["hash"]
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    end = top.select("tree", "round", nothing.alias("path"))
    if upper:
        tops = descend(upper, end, keep, "forest").select(F.col("slot.of").alias("tree"), F.col("slot.round").alias("round"), "path", F.col("slot.hash").alias("subroot"))
    else:
        tops = forest.select(F.col("of").alias("tree"), "round", nothing.alias("path"), F.col("hash").alias("subroot"))
    tops = keep(tops, "tops")
    small = leafed.where("left = 0").join(tops, "tree").select("tree", F.col("hash").alias("leaf"), *others, "path", "subroot")
    if not rounds:
        return small.withColumn("root", F.lit(root).cast("string"))
    found = descend(rounds, tops, keep, "tree").select("tree", F.col("slot.hash").alias("leaf"), *[F.col(f"slot.{c}").alias(c) for c in others], "path", "subroot")
    return found.unionByName(small.select(found.columns)).withColumn("root", F.lit(root).cast("string"))
