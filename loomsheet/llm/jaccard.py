"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its word shingles. Two sets with similarity t must share a shingle among
the first n - ceil(t n) + 1 of each, under any one order of all shingles; so they must under each of
several orders. Prefixes that are x shingles longer must share 1 + x. All orders put frequent shingles
last and the rest by a hash, each order by another. The steps:

1. Count, per task, shingles that recur there; the ``FREQUENT`` most frequent, a bounded list, go last.
   The list only steers the orders: any order gives the same links.
2. Equal sets become one node. Each node lists its prefix under the first order, with positions.
   Only shingles in the prefixes of two nodes find anything.
3. Within each shared shingle and class of sizes, every node is paired with one pivot, the node that
   holds it earliest: as many pairs as nodes, not their square. Length and position bounds drop pairs.
   The nodes of what is left get their longer prefixes under two more orders, which must share enough
   under each: the filters of all orders are intersected. Only texts of pairs that pass travel to be
   compared whole.
4. Components of these links. Within a shared shingle, nodes of different components are then
   paired, filtered and verified alike, so no link between components is missed. The smaller set of a
   pair must hold the shingle early enough to reach the larger one's size. A shingle with more than
   ``HELD`` holders is split before any pairing: by classes of sizes that can be similar, then, while
   still crowded, by the shingles of the second order's prefixes and of the third's, which similar sets
   must share too. What is crowded after that is salted.
5. Components of all links.

So every link either is verified or joins two documents that verified links connect already; for the
component of each document nothing is lost. The number of links needs the pairs inside components
too: ``join`` counts them where asked, by comparing all sets of a component in pairs of blocks.
Intermediate tables are deleted as soon as no later step reads them.

Defined results: null texts and texts without words have no shingles and their own id as component;
repeated rows are linked and each is returned; a row without a doc_id links nothing, and shows the
component of its set if rows with ids have that set; rows that share a doc_id are told apart by text;
texts of any length are taken whole; extra columns are dropped by ``join`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import Tables, bounded, slices, text_of, utf8
from .graph import components

FREQUENT = 100_000
HIGHEST = 100_000  # counts are told apart up to it
EXTRA_PERCENT = 3
FLUSH = 1_000_000  # shingles counted together in a task
BLOCK = 500_000  # bytes of text hashed together
HELD = 1_000  # holders of a shingle that a task of step 4 pairs with the others
PAIRED, PAIRED_SHINGLES = 1_024, 2_000_000  # sets, and shingles in them, of a block whose links are counted
WIDE = 4_096  # shingles that a step of the counting compares
LISTED = 2_000_000  # rows of two longs that may be broadcast
# Fixed seeds of the further orders; the first is by the shingles' own hashes.
FURTHER = {"second": 0x1F83D9ABFB41BD6B, "third": 0x5BE0CD19137E2179}


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text", BLOCK):
            yield part, sh.shingles(*sh.words(*utf8(part.column("text"))), n)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _lists(arrays: list[np.ndarray], kind: np.dtype) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *arrays])))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def _extra(n):
    """How many shingles beyond the shortest prefix are listed; similar sets share one more for each."""
    return n * EXTRA_PERCENT // 100


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent(docs: DataFrame, n: int, keep: Tables, most: int = FREQUENT) -> np.ndarray:
    """At most ``most`` shingles that recur within tasks, ascending by hash, and the order of their frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                all_of = np.concatenate(held)
                all_of.sort()
                first = np.flatnonzero(np.append(True, all_of[1:] != all_of[:-1]))
                many = np.diff(np.append(first, len(all_of)))
                keep = many > 1
                yield pa.RecordBatch.from_arrays([_long(all_of[first[keep]]), pa.array(many[keep])], ["token", "many"])

        for _, sets in _sets(batches, n):
            held += sets
            size += sum(map(len, sets))
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        yield from flush()

    found = bounded(docs.select(text_of().alias("text"))).mapInArrow(count, "token long, many long")
    counted = keep(found.groupBy("token").agg(F.sum("many").alias("many")).where("many > 2"), "frequent")
    # The least count that at most ``most`` shingles reach, from a histogram with a row for each count.
    histogram = counted.groupBy(F.least("many", F.lit(HIGHEST)).alias("many")).agg(F.count(F.lit(1)).alias("tokens")).collect()
    total, least = 0, HIGHEST + 1
    for r in sorted(histogram, key=lambda r: -r["many"]):
        if (total := total + r["tokens"]) > most:
            break
        least = r["many"]
    top = sorted(counted.where(F.col("many") >= least).collect(), key=lambda r: (-r["many"], r["token"]))
    keep.drop("frequent")
    tokens = np.array([r["token"] for r in reversed(top)], np.int64).view(np.uint64)  # the most frequent last
    by_hash = np.argsort(tokens)
    return np.stack([tokens[by_hash], by_hash.astype(np.uint64)])


def _ordered(s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An ascending set without the shingles in ``last``, and those, by their frequency."""
    if not last.shape[1] or not len(s):
        return s, s[:0]
    at = np.searchsorted(last[0], s)
    at[at == last.shape[1]] = 0
    late = last[0][at] == s
    return s[~late], s[late][np.argsort(last[1][at[late]])]


def _first(early: np.ndarray, late: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The first shingles of a set under the order of a seed: 32 bits of each, distinct."""
    keys = sh.mix(early ^ np.uint64(seed))
    if length < len(early):
        keys = keys[np.argpartition(keys, length - 1)[:length]]
    keys = np.concatenate([keys, sh.mix(late[: max(0, length - len(early))] ^ np.uint64(seed))])
    return np.unique((keys >> np.uint64(32)).astype(np.uint32))


def _can_link(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _can_reach(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Whether sets that first meet at these positions can overlap enough."""
    return F.least(na - pa_, nb - pb) * (100 + percent) >= percent * (na + nb)


def share_enough(order: str, percent: int) -> Column:
    """Whether the longer prefixes of a pair under an order share as many shingles as those of similar sets must.

    Where shingles of one set have the same 32 bits, that many may be missing in the count.
    """
    length = lambda n: n - F.ceil(n * percent / 100) + 1 + F.floor(n * EXTRA_PERCENT / 100)
    a, b = F.col(f"a.{order}"), F.col(f"b.{order}")
    merged = F.least(length(F.col("a.n")) - F.size(a), length(F.col("b.n")) - F.size(b))
    return F.size(F.array_intersect(a, b)) + merged >= 1 + F.floor(F.least("a.n", "b.n") * EXTRA_PERCENT / 100)


def _listed(df: DataFrame) -> DataFrame:
    """A table of two longs, to be broadcast if it has ``LISTED`` rows at most."""
    return F.broadcast(df) if df.count() <= LISTED else df


def with_prefixes(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) as p, with the prefixes of both as a and b."""
    return prefixes.alias("a").join(_listed(pairs).alias("p"), F.col("p.a") == F.col("a.node")).join(prefixes.alias("b"), F.col("p.b") == F.col("b.node"))


def _enough(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs that share enough under every order: the intersection of the filters."""
    out = with_prefixes(pairs, prefixes)
    for order in FURTHER:
        out = out.where(share_enough(order, percent))
    return out.select("p.a", "p.b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _texts(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, keep: Tables) -> DataFrame:
    """(node, text) of the wanted nodes; a doc_id that stands for several texts brings them all."""
    wanted = keep(wanted.join(nodes.select("node", "row"), "node"), "wanted")
    return docs.join(_listed(wanted), "row").select("node", "text")


def _prefixes(texts: DataFrame, n: int, percent: int, last: np.ndarray) -> DataFrame:
    """(node, n, a column for each order): the longer prefixes of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, n):
            own = [k for k, (node, s) in enumerate(zip(part.column("node").to_pylist(), sets, strict=True)) if node_of(s) == node]
            lengths = [prefix_length(len(sets[k]), percent) + _extra(len(sets[k])) for k in own]
            ordered = [_ordered(sets[k], last) for k in own]
            lists = [_lists([_first(*o, length, seed) for o, length in zip(ordered, lengths, strict=True)], np.uint32) for seed in FURTHER.values()]
            lists = [pa.ListArray.from_arrays(x.offsets, x.values.view(pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(own, pa.int64())), pa.array([len(sets[k]) for k in own], pa.int64()), *lists], ["node", "n", *FURTHER])

    return bounded(texts).mapInArrow(run, "node long, n long, " + ", ".join(f"{order} array<int>" for order in FURTHER))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, percent: int, keep: Tables) -> DataFrame:
    """The links among ``pairs`` (a, b), by whole sets. Texts are smaller than sets of hashes, so the texts travel."""
    texts = _texts(_ends(pairs), docs, nodes, keep)
    both = texts.toDF("a", "ta").join(_listed(pairs), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", BLOCK):
                sides = [sh.shingles(*sh.words(*utf8(part.column(c))), n) for c in ("ta", "tb")]
                held = []
                for a, b, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), *sides, strict=True):
                    # A doc_id that stands for several texts brings them all; only the nodes' own are meant.
                    held.append(node_of(x) == a and node_of(y) == b and _similar(x, y, percent))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(held, pa.bool_()))

    return bounded(both.select("a", "b", "ta", "tb")).mapInArrow(run, "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = _common(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def _holds(sets: list[np.ndarray], tokens: np.ndarray) -> np.ndarray:
    """A row for each set, a column for each of the ascending tokens: 1 where the set has the token."""
    out = np.zeros((len(sets), len(tokens)), np.float32)
    for row, s in zip(out, sets, strict=True):
        s = s[np.searchsorted(s, tokens[0]) : np.searchsorted(s, tokens[-1], side="right")]
        at = np.searchsorted(tokens, s)
        row[at[tokens[at] == s]] = 1
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether each of the left sets is similar to each of the right ones."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    common = np.zeros((len(left), len(right)), np.float32)  # exact, since sets are smaller than 2**24
    for k in range(0, len(both), WIDE):
        tokens = both[k : k + WIDE]
        common += _holds(left, tokens) @ _holds(right, tokens).T
    common = common.astype(np.int64)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])
    return 100 * common >= percent * (sizes - common)


def _degrees(labels: DataFrame, texts: DataFrame, nodes: DataFrame, n: int, percent: int, keep: Tables) -> DataFrame:
    """(node, n_links): how many other sets are similar to each node's set, counted over all pairs of its component.

    A component's nodes lie in blocks by hash, and each pair of blocks is a group of its own.
    """
    members = nodes.join(labels.select(F.col("v").alias("node"), "label"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / PAIRED), F.ceil(F.sum("n") / PAIRED_SHINGLES)).cast("int")
    members = members.join(members.groupBy("label").agg(blocks.alias("blocks")), "label")
    members = keep(members.select("node", "row", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "members")
    dealt = texts.join(F.broadcast(members) if members.count() <= LISTED else members, "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "text")

    def count(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        held: dict[int, dict[int, np.ndarray]] = {i: {}, j: {}}
        for part, sets in _sets(iter(group.combine_chunks().to_batches()), n):
            for node, block, s in zip(part.column("node").to_pylist(), part.column("block").to_pylist(), sets, strict=True):
                if node_of(s) == node:  # a doc_id that stands for several texts brings them all
                    held[block][node] = s
        left, right = held[i], held[j]
        if not left or not right:
            return pa.table({"node": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
        linked = _linked(list(left.values()), list(right.values()), percent)
        if i == j:  # a set isn't linked to itself
            return pa.table({"node": pa.array(list(left), pa.int64()), "n_links": pa.array(linked.sum(1) - 1, pa.int64())})
        return pa.table({"node": pa.array([*left, *right], pa.int64()), "n_links": pa.array(np.concatenate([linked.sum(1), linked.sum(0)]), pa.int64())})

    return dealt.groupBy("label", "i", "j").applyInArrow(count, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def sketches(rows: DataFrame, n: int, percent: int, last: np.ndarray) -> DataFrame:
    """doc_id, node, n for each row, and its prefix under the first order where it is the first of its task with that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, sets in _sets(batches, n):
            nodes = [node_of(s) if len(s) else None for s in sets]
            prefixes = []
            for doc_id, node, s in zip(part.column("doc_id").to_pylist(), nodes, sets, strict=True):
                new = node is not None and doc_id is not None and node not in seen
                prefixes.append(np.concatenate(_ordered(s, last))[: prefix_length(len(s), percent)] if new else s[:0])
                if new:
                    seen.add(node)
            lists = _lists(prefixes, np.uint64)
            signed = pa.ListArray.from_arrays(lists.offsets, lists.values.view(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), signed], ["doc_id", "node", "n", "prefix"])

    return bounded(rows).mapInArrow(run, "doc_id long, node long, n long, prefix array<long>")


def _size(n: str, percent: int) -> Column:
    """The class of a size: similar sets are of the same class or of neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(max(100 / percent, 1.05)))).cast("int")


def near_pivots(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): within each shingle and class of sizes, each node with the node that holds the shingle earliest."""
    sized = tokens.withColumn("size", _size("n", percent))
    pivots = sized.groupBy("token", "size").agg(F.min(F.struct("at", "n", "node")).alias("p"))
    pivots = pivots.select("token", "size", F.col("p.at").alias("pat"), F.col("p.n").alias("pn"), F.col("p.node").alias("pivot"))
    return (
        sized.join(pivots, ["token", "size"])
        .where((F.col("node") != F.col("pivot")) & _can_link(F.col("n"), F.col("pn"), percent) & _can_reach(F.col("n"), F.col("at"), F.col("pn"), F.col("pat"), percent))
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )


def _reach(percent: int) -> Column:
    """The largest set that is similar to one whose first shared shingle is at ``at``; below ``n``, only smaller sets are."""
    return F.least(F.expr(f"(n - at) * {100 + percent} div {percent} - n"), F.expr(f"n * 100 div {percent}"))


def _facing(rows: DataFrame, key: str) -> DataFrame:
    """The smaller (``low``) and larger (``high``) sides of each key that meet one of another component, with ``many``, the number of larger ones.

    A side that meets only its own component is taken off its row, and rows without a side go.
    """
    side = lambda f, role: f(F.when(F.col(role), F.col("label")))
    ends = [side(f, role).alias(f"{role}_{end}") for role in ("low", "high") for end, f in (("from", F.min), ("to", F.max))]
    span = rows.groupBy(key).agg(*ends, F.count_if("high").alias("many"))
    span = span.where("low_from IS NOT NULL AND high_from IS NOT NULL AND NOT (low_from = high_to AND low_to = high_from)")
    meets = lambda other: (F.col(f"{other}_from") != F.col("label")) | (F.col(f"{other}_to") != F.col("label"))
    met = rows.join(span, key).withColumns({"low": F.col("low") & meets("high"), "high": F.col("high") & meets("low")})
    return met.where("low OR high").select(*rows.columns, "many")


def _by_size(held: DataFrame, percent: int) -> DataFrame:
    """Each holder on the larger side of its own class of sizes, and on the smaller side of the classes that it can reach.

    A shingle late in a set can't be the first one shared with a set as large or larger, so a holder that
    has it late is on no smaller side: where all have it late, nothing is paired.
    """
    own, reach = _size("n", percent), _reach(percent)
    reached = F.when(reach >= F.col("n"), _size("reach", percent)).otherwise(own)
    out = held.withColumn("reach", reach).withColumns({"own": own, "size": F.explode(F.sequence(own, reached))})
    out = out.withColumns({"low": F.col("reach") >= F.col("n"), "high": F.col("size") == F.col("own"), "key": F.xxhash64("token", "size")})
    return out.drop("token", "size", "own", "reach")


def between_components(tokens: DataFrame, labels: DataFrame, prefixes_of: Callable[[DataFrame], DataFrame], percent: int, keep: Tables) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a shingle; a crowded one by sizes, then with shingles of further orders."""
    grouped = tokens.join(labels.select(F.col("v").alias("node"), "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    grouped = grouped.withColumns({"low": _reach(percent) >= F.col("n"), "high": F.lit(True)})
    held = keep(_facing(keep(grouped, "grouped"), "token"), "held")
    keep.drop("grouped")
    columns = ["key", "node", "n", "at", "label", "low", "high", "many"]
    keyed = held.where(F.col("many") <= HELD).withColumn("key", F.col("token")).select(columns)
    crowded = held.where(F.col("many") > HELD).drop("many", "low", "high")
    if not crowded.isEmpty():
        rest = keep(_facing(_by_size(crowded, percent), "key"), "keys")
        for order in FURTHER:
            keyed = keyed.unionByName(rest.where(F.col("many") <= HELD).select(columns))
            rest = rest.where(F.col("many") > HELD).drop("many")
            if rest.isEmpty():
                break
            listed = prefixes_of(rest.select("node").distinct()).select("node", F.col(order).alias("shingles"))
            finer = rest.join(listed, "node").withColumn("shingle", F.explode("shingles")).withColumn("key", F.xxhash64("key", "shingle"))
            rest = keep(_facing(finer.drop("shingle", "shingles"), "key"), "keys")
        else:
            keyed = keyed.unionByName(rest.select(columns))
    keyed = keep(keyed, "keyed")
    keep.drop("held", "keys")
    # A key that is still crowded is dealt over tasks: each takes some of the larger sides and pairs them with all smaller ones.
    salts = F.ceil(F.col("many") / HELD).cast("int")
    left = keyed.where("low").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    right = keyed.where("high").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
    right = right.select("key", "salt", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "at", "label")])
    return (
        left.join(right, ["key", "salt"])
        .where("(n < o_n OR n = o_n AND node < o_node) AND label <> o_label")
        .where(_can_link(F.col("n"), F.col("o_n"), percent) & _can_reach(F.col("n"), F.col("at"), F.col("o_n"), F.col("o_at"), percent))
        .select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))
        .distinct()
    )


def join(docs: DataFrame, n: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    ``count_links`` adds n_links: the exact number of other sets that are similar to the row's set.
    """
    keep = Tables(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    last = frequent(rows, n, keep)
    sketch = keep(sketches(rows, n, percent, last), "sketch")
    # One document stands for each node; its text is read again when the node's set is needed.
    nodes = keep(sketch.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("row"), F.first("n").alias("n")), "nodes")
    tokens = sketch.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("token")
    tokens = keep(tokens.join(shared, "token").distinct(), "shared")

    texts = rows.select(F.col("doc_id").alias("row"), "text")

    def prefixes_of(wanted: DataFrame) -> DataFrame:
        found = keep(_prefixes(_texts(wanted, texts, nodes, keep), n, percent, last), "prefixes")
        # A repeated row brings its node more than once; mostly there is none, and nothing is shuffled.
        return found if found.count() == wanted.count() else keep(found.dropDuplicates(["node"]), "prefixes")

    first = keep(near_pivots(tokens, percent), "first")
    passed = keep(_enough(first, prefixes_of(_ends(first)), percent), "passed")
    links = keep(_verified(passed, texts, nodes, n, percent, keep), "links")
    keep.drop("passed", "wanted", "prefixes")
    labels = components(links, keep)

    second = between_components(tokens, labels, prefixes_of, percent, keep)
    second = keep(second.join(first, ["a", "b"], "left_anti"), "across")
    keep.drop("shared", "first", "keyed")
    passed = keep(_enough(second, prefixes_of(_ends(second)), percent), "passed")
    if not passed.isEmpty():
        links = keep(links.unionByName(_verified(passed, texts, nodes, n, percent, keep)), "links")
        labels = components(links, keep)
    keep.drop("across", "passed", "wanted", "prefixes", "links")

    named = nodes.join(labels.select(F.col("v").alias("node"), "label"), "node", "left").select("node", "row", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("row").alias("component_id"))
    of_node = named.join(smallest, "label").select("node", "component_id")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    if count_links:
        of_node = of_node.join(_degrees(labels, texts, nodes, n, percent, keep), "node", "left")
        out.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    result = keep(sketch.select("doc_id", "node", "n").join(of_node, "node", "left").select(*out), "components")
    keep.drop_all("components")
    return result


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, once each; rows without a doc_id stay.

    Texts are shuffled only where a doc_id occurs more than once, or where more than ``LISTED`` ids go.
    """
    keep = Tables(docs.sparkSession)
    of_id = join(docs, n, percent).where("doc_id IS NOT NULL").groupBy("doc_id")
    of_id = of_id.agg(F.count(F.lit(1)).alias("many"), F.max(F.expr("doc_id = component_id")).alias("kept")).where("many > 1 OR NOT kept")
    of_id = keep(of_id.select("doc_id", "kept"), "ids")
    known = lambda ids: F.broadcast(ids) if ids.count() <= LISTED else ids
    gone, repeated = of_id.where("NOT kept"), of_id.where("kept")
    stay = docs.join(known(gone.select("doc_id")), "doc_id", "left_anti")
    repeated = known(repeated.select("doc_id"))
    once = stay.join(repeated, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return stay.join(repeated, "doc_id", "left_anti").unionByName(once).select(docs.columns)
