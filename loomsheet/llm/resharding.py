"""Resharding by minimum-cost flow.

Old shards have sizes, new shards capacities of an equal share each. A transfer of bytes from old
shard i to new shard j costs nothing if i = j, since those rows stay in their file, and one a byte
otherwise. The cheapest flow says how many bytes go where; it is solved on the driver over the shards
only, however many rows there are. Each old shard's rows then lie on an axis of bytes, in blocks by
a hash, and are cut where the flow says. A row goes to where its middle lies; rows over a cut, one for each cut, change sides
as long as that makes the new shards more even.

What stays at home comes first on an axis, and rows lie in the order of their sizes, the largest first, by
powers of two: so large rows stay where they are, and cuts fall between small rows as far as can be. Places on
the axis are sums of a block's start, from a table of block sums, and of the rows before it in its block, so
that no task sorts a whole shard.

Defined results: a null text has no bytes and a size of 16; equal rows may be parted; rows without an
old shard count to shard 0; rows without a doc_id are placed like others; an empty table gives no
rows; extra columns are dropped by ``plan`` and kept by ``rewrite``, but for one named shard; a shard that
ends empty has no folder.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import delete
from .common import written

ROWS_A_BLOCK = 5_000
OVERHEAD = 16  # bytes that a row takes besides its text


def cheapest_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Transfers (i, j) -> amount that meet all supplies and demands, whose sums are equal, at the least cost.

    Successive shortest paths with potentials over the complete bipartite graph.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    m, n = len(supply), len(demand)
    left, right = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    potential = [0] * (m + n)
    while any(left):
        far, back = [float("inf")] * (m + n), [-1] * (m + n)
        heap = []
        for i in range(m):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        done = [False] * (m + n)
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            if v < m:
                ways = ((m + j, cost(v, j)) for j in range(n))
            else:
                ways = ((i, -cost(i, v - m)) for i in range(m) if flow.get((i, v - m)))
            for w, c in ways:
                e = d + c + potential[v] - potential[w]
                if e < far[w]:
                    far[w], back[w] = e, v
                    heapq.heappush(heap, (e, w))
        end = min((m + j for j in range(n) if right[j]), key=lambda w: (far[w], w))
        reach = far[end]
        for v in range(m + n):
            potential[v] += min(far[v], reach)
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        most = min(left[path[0]], right[end - m])
        for a, b in zip(path, path[1:], strict=False):
            if a >= m:
                most = min(most, flow[b, a - m])
        for a, b in zip(path, path[1:], strict=False):
            if a < m:
                flow[a, b - m] += most
            else:
                flow[b, a - m] -= most
        left[path[0]] -= most
        right[end - m] -= most
    return {k: v for k, v in sorted(flow.items()) if v}


def capacities(loads: list[int], rest: int) -> list[int]:
    """How much of ``rest`` each shard takes, so that all are filled to one level as far as can be."""
    order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
    low, high = 0, max(loads) + rest + 1
    while low < high:  # the lowest level that has room for all
        mid = (low + high) // 2
        if sum(max(0, mid - x) for x in loads) >= rest:
            high = mid
        else:
            low = mid + 1
    out = [max(0, low - x) for x in loads]
    over = sum(out) - rest
    for j in order:
        take = min(over, 1, out[j])
        out[j] -= take
        over -= take
    return out


def evened(loads: list[int], over: list[tuple[int, int, int]]) -> list[int]:
    """Which rows over a cut (size, shard, other side) go to the other side, so that no further change makes the loads more even."""
    loads, flipped = list(loads), set()
    while True:
        best, least = None, 0
        for k, (size, a, b) in enumerate(over):
            a, b = (b, a) if k in flipped else (a, b)
            gain = (loads[a] - size) ** 2 + (loads[b] + size) ** 2 - loads[a] ** 2 - loads[b] ** 2
            if gain < least:
                best, least = k, gain
        if best is None:
            return sorted(flipped)
        size, a, b = over[best]
        a, b = (b, a) if best in flipped else (a, b)
        loads[a], loads[b] = loads[a] - size, loads[b] + size
        flipped ^= {best}


def sized(docs: DataFrame, old, *further: Column) -> DataFrame:
    """doc_id, size, text_crc32, the old shard and ``further`` columns of each row; written once, without the texts."""
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(0)).alias("old"), *further)
    return written(rows, "sizes")


def plan(rows: DataFrame, new_shards: int, n_old: int) -> DataFrame:
    """Adds shard to rows with doc_id, size, text_crc32, old (0 to n_old - 1)."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    key = ["doc_id", "text_crc32", "size"]
    supply, blocks = [0] * n_old, [1] * n_old
    for r in rows.groupBy("old").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("many")).collect():  # a row for each old shard
        supply[r["old"]], blocks[r["old"]] = r["size"], -(-r["many"] // ROWS_A_BLOCK)
    flow = cheapest_flow(supply, capacities([0] * new_shards, total), lambda i, j: int(i != j))
    cuts: dict[int, tuple[list[int], list[int]]] = {}
    for i in range(n_old):
        at, ends, to = 0, [], []
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            at += flow[i, j]
            ends.append(at)
            to.append(j)
        cuts[i] = ends, to
    table = spark.createDataFrame([(i, ends, to) for i, (ends, to) in cuts.items()], "old int, ends array<long>, targets array<int>")

    # As many blocks for each old shard as its rows need, so that a hot shard's blocks are no larger.
    share = F.pmod(F.xxhash64(*key), F.get(F.array(*[F.lit(b) for b in blocks]), F.col("old")))
    dealt = rows.withColumn("block", F.struct((-F.floor(F.log2("size"))).alias("power"), share.alias("share")))
    starts = dealt.groupBy("old", "block").agg(F.sum("size").alias("bytes"))
    starts = starts.select("old", "block", (F.sum("bytes").over(Window.partitionBy("old").orderBy("block")) - F.col("bytes")).alias("start"))
    inside = Window.partitionBy("old", "block").orderBy(*key)
    ranked = dealt.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    low = F.col("start") + F.col("before")
    middle = low + F.floor(F.col("size") / 2)
    at = F.least(F.size(F.filter("ends", lambda e: e <= F.col("middle"))), F.size("targets") - 1)
    placed = ranked.join(starts, ["old", "block"]).select(*key, "old", low.alias("low"), middle.alias("middle"))
    placed = placed.join(F.broadcast(table), "old").withColumn("at", at)  # one row for each old shard
    # A row that lies over a cut may go to the cut's other side as well.
    before, after = F.get("ends", F.col("at") - 1), F.get("ends", "at")
    other = F.when(before > F.col("low"), F.get("targets", F.col("at") - 1)).when(after < F.col("low") + F.col("size"), F.get("targets", F.col("at") + 1))
    placed = written(placed.select(*key, "old", "low", F.get("targets", "at").alias("shard"), other.alias("other")), "placed")
    loads = {r["shard"]: r["size"] for r in placed.groupBy("shard").agg(F.sum("size").alias("size")).collect()}  # a row for each new shard
    over = placed.where("other IS NOT NULL").select("old", "low", "size", "shard", "other").collect()  # a row for each cut at most
    flips = evened([loads.get(j, 0) for j in range(new_shards)], [(r["size"], r["shard"], r["other"]) for r in over])
    chosen = spark.createDataFrame([(over[k]["old"], over[k]["low"], over[k]["other"]) for k in flips], "old int, low long, flipped int")
    return placed.join(F.broadcast(chosen), ["old", "low"], "left").select(*key, "old", F.coalesce("flipped", "shard").alias("shard"))


def with_slots(planned: DataFrame) -> DataFrame:
    """Adds slot: the place of a row in its shard, from 0 without gaps, counted in blocks."""
    planned = written(planned, "plan")
    n, shards = planned.agg(F.count(F.lit(1)), F.coalesce(F.max("shard"), F.lit(0)) + 1).first()
    blocks = max(1, -(-n // (shards * ROWS_A_BLOCK)))
    key = ["doc_id", "text_crc32", "size"]
    rows = planned.withColumn("block", F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(blocks)))
    starts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("many"))
    starts = starts.select("shard", "block", (F.sum("many").over(Window.partitionBy("shard").orderBy("block")) - F.col("many")).alias("start"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "block").orderBy(*key, "old")))
    return ranked.join(starts, ["shard", "block"]).withColumn("slot", F.col("start") + F.col("place") - 1).drop("block", "start", "place")


def moved_bytes(planned: DataFrame) -> DataFrame:
    """(old, shard, bytes): the transfers that a plan makes."""
    return planned.where("old <> shard").groupBy("old", "shard").agg(F.sum("size").alias("bytes"))


def lay(docs: DataFrame, shard: Column, path: str) -> None:
    """Writes ``docs`` as ``path/shard=j``."""
    docs.withColumn("shard", F.coalesce(shard.cast("int"), F.lit(0))).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def held(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """The rows of a folder of shards; ``docs`` has their columns."""
    return spark.read.schema(docs.withColumn("shard", F.lit(0)).select(*[c for c in docs.columns if c != "shard"], "shard").schema).parquet(path)


def _identity(df: DataFrame, size: Column, crc: Column, old: Column | None) -> DataFrame:
    """Adds columns, none of them null, that tell rows apart as far as a plan does."""
    df = df.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("__none", F.col("doc_id").isNull())
    return df.withColumn("__size", size).withColumn("__crc", crc).withColumn("__old", F.lit(0) if old is None else F.coalesce(old.cast("int"), F.lit(0)))


def rewrite(docs: DataFrame, planned: DataFrame, path: str, old: Column | None = None) -> list[int]:
    """Writes anew, as ``path/shard=j``, the shards that gain or lose rows, and deletes those left empty; returns them.

    New folders are swapped for old ones once all are written; what is lost with the driver during the swap
    lies whole in ``_new-`` and ``_old-`` folders, which readers pass over.

    Rows without a doc_id and rows that share one are told apart by text; of equal rows, as many go to
    each shard as the plan says. ``old`` is the shard where a row of ``docs`` lies; it's needed where equal
    rows of different shards differ in further columns.
    """
    spark = docs.sparkSession
    planned = written(planned, "plan")
    changed = planned.where("old <> shard")
    affected = sorted(r[0] for r in changed.select("shard").union(changed.select("old")).distinct().collect())  # shards, not rows
    key = ["__id", "__none", "__size", "__crc", "__old"]
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    rows = _identity(docs.drop("shard") if old is None else docs, (F.octet_length(data) + OVERHEAD).cast("long"), F.crc32(data), old).drop("shard")
    if old is not None:  # no row leaves a shard that isn't affected
        rows = rows.where(F.col("__old").isin(affected))
    # For each kind of row, how many go to each shard: one row, so that texts are shuffled once.
    targets = _identity(planned, F.col("size"), F.col("text_crc32"), None if old is None else F.col("old")).groupBy(*key, "shard").agg(F.count(F.lit(1)).alias("many"))
    targets = targets.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("shard", "many"))).alias("__targets"))
    copies = rows.join(targets, key).withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))).cast("long"))
    pick = F.aggregate(
        "__targets",
        F.struct(F.col("__copy").alias("left"), F.lit(None).cast("int").alias("shard")),
        lambda a, t: F.struct((a["left"] - t["many"]).alias("left"), F.when((a["left"] > 0) & (a["left"] <= t["many"]), t["shard"]).otherwise(a["shard"]).alias("shard")),
        lambda a: a["shard"],
    )
    out = copies.withColumn("shard", pick).where(F.col("shard").isin(affected)).drop(*key, "__targets", "__copy")
    # What is written lies beside the old files until it is whole; these go at the end, so that no moment has a row nowhere.
    made, gone = f"{path}/_new-{uuid.uuid4().hex}", f"{path}/_old-{uuid.uuid4().hex}"
    out.write.option("compression", "zstd").partitionBy("shard").parquet(made)
    files = spark._jvm.org.apache.hadoop.fs
    system = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(files.Path(gone))
    for j in affected:
        for start, end in ((path, gone), (made, path)):
            held = files.Path(f"{start}/shard={j}")
            if system.exists(held) and not system.rename(held, files.Path(f"{end}/shard={j}")):
                raise OSError(f"{held} can't be moved")
    delete(spark, made)
    delete(spark, gone)
    return affected
