"""Search over all columns, by a scan or with a word index: O-100 to O-103."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_text, kind, quoted
from ..sources.shared import delete

BLOCK_ROWS = 10_000
LIMIT = 1000
PART = 10_000  # blocks whose numbers lie together in a row of the words
RANGES = 64  # ranges of row numbers that a search reads, at most
PAIRS, BYTES = 3_000_000, 64 << 20  # pairs of a word and a block, and bytes of text, that a task holds before it hands them on
PIECE = 8 << 20  # bytes of words that a task hands on at once
ALPHABETIC = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))  # symbols that count as letters
GRAM = 3  # characters of a word that the look-up goes by
WORDS = 2_000  # of one run of the query; a run inside more words than these rules out too little to look further
BLOCKS = 4_096  # that are listed one by one
SHARE = 0.5  # of all blocks, from which the whole table is read
COMMON = "etaoinsrhldu"  # letters by which a frequent gram is told from a rare one


def terms_of(query: str) -> list[str]:
    """Lower-case words of a query, the longest first, since it rules out most."""
    found = sorted({t.lower() for t in query.split()}, key=lambda t: (-len(t), t))
    if not found:
        raise ValueError("the query is blank")
    return found


def _can_hold(dt: T.DataType, term: str) -> bool:
    """Whether a value of the type can contain the term at all."""
    what = kind(dt)
    if what in ("integer", "boolean"):
        return set(term) <= set("0123456789-" if what == "integer" else "truefals")
    if what == "float":
        return set(term) <= set("0123456789-+.einfa")
    return what != "binary"


def search_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The lower-case text of a row: columns joined by line feeds, nested ones as JSON, nulls left out."""
    fields = [f for f in df.schema if (columns is None or f.name in columns) and kind(f.dataType) != "binary"]
    return F.lower(F.concat_ws("\n", *[as_text(quoted(f.name), f.dataType) for f in fields]))


def matches(df: DataFrame, query: str, columns: list[str] | None = None) -> Column:
    """Whether each term of the query occurs somewhere in the row."""

    def one(term: str) -> Column:
        names = [f.name for f in df.schema if (columns is None or f.name in columns) and _can_hold(f.dataType, term)]
        return search_text(df, names).contains(term) if names else F.lit(False)

    return reduce(lambda a, b: a & b, [one(t) for t in terms_of(query)])


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """All rows with every term, whatever the case."""
    return df.where(matches(df, query, columns))


def search_page(df: DataFrame, query: str, order_by: list[str], columns: list[str] | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    return search(df, query, columns).orderBy(*[quoted(c) for c in order_by]).offset(offset).limit(min(limit, LIMIT))


def highlights(df: DataFrame, query: str, new_column: str = "highlights") -> DataFrame:
    """Adds the text columns, by name, that contain any of the terms."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    hit = lambda c: reduce(lambda a, b: a | b, [F.lower(quoted(c)).contains(t) for t in terms_of(query)])
    entries = [F.when(hit(c), F.struct(F.lit(c).alias("key"), quoted(c).alias("value"))) for c in texts]
    return df.withColumn(new_column, F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.create_map())


@lru_cache
def runs_pattern() -> str:
    """A run of word characters: letters, marks, decimal digits, connectors, letter numbers and joiners, as Java's ``\\w`` for all of Unicode."""
    named = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "Pc"}
    inside = bytearray(unicodedata.category(chr(c)) in named for c in range(sys.maxunicode + 1))
    for lo, hi in (*ALPHABETIC, (0x200C, 0x200D)):
        inside[lo : hi + 1] = b"\1" * (hi + 1 - lo)
    return "[" + "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(b"\1+", inside)) + "]+"


# ASCII characters outside words become spaces; bytes of others stay.
SPACED = bytes(c if c >= 128 or chr(c).isalnum() or c == ord("_") else ord(" ") for c in range(256))


def _cut(pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of block and text to the words of the blocks, with as many blocks of a word in a row as a task holds at once.

    Texts are cut at ASCII characters as bytes; only different pieces with others go through the pattern.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        parts: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        here: set[bytes] = set()
        seen: dict[bytes, list[bytes]] = {}
        at, pairs, size = None, 0, 0

        def close() -> None:
            tokens = parts[at // PART]
            for piece in [p for p in here if not p.isascii()]:
                if piece not in seen:
                    seen[piece] = [t.encode() for t in find(piece.decode("utf-8", "replace"))]
                here.remove(piece)
                here.update(seen[piece])
            for token in here:
                tokens[token].append(at)

        def rows() -> Iterator[pa.RecordBatch]:
            for part, tokens in parts.items():
                ends = np.cumsum([0, *map(len, tokens.values())])
                blocks = np.fromiter(chain.from_iterable(tokens.values()), np.int64, ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(blocks))
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(np.full(len(tokens), part)), lists], ["token", "part", "blocks"])
            parts.clear()
            seen.clear()

        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at:
                    if here:
                        close()
                        pairs, here = pairs + len(here), set()
                    if pairs >= PAIRS or size >= BYTES:
                        yield from rows()
                        pairs = size = 0
                    at = block
                here.update(text.translate(SPACED).split())
                size += len(text)
        if here:
            close()
        yield from rows()

    return cut


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one word and part, which follow one another, as one row with each block once; ``first`` marks a word's first part."""
    last, before = None, None

    def one(rows: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        nonlocal before
        token, part, lists = rows.columns
        starts, blocks = np.flatnonzero(new), lists.flatten().to_numpy()
        of = np.repeat(np.cumsum(new) - 1, pc.list_value_length(lists).to_numpy())
        if not np.all((of[1:] != of[:-1]) | (blocks[1:] > blocks[:-1])):
            order = np.lexsort((blocks, of))
            of, blocks = of[order], blocks[order]
            once = np.append(True, (of[1:] != of[:-1]) | (blocks[1:] != blocks[:-1]))
            of, blocks = of[once], blocks[once]
        ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(starts))))
        token, part = token.take(pa.array(starts)), part.take(pa.array(starts))
        first = np.append(token[0].as_py() != before, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))
        before = token[-1].as_py()
        return pa.RecordBatch.from_arrays([token, part, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(blocks)), pa.array(first)], ["token", "part", "blocks", "first"])

    def starts_of(rows: pa.RecordBatch) -> np.ndarray:
        token, part = rows.column(0), rows.column(1)
        other = pc.or_(pc.not_equal(token[1:], token[:-1]), pc.not_equal(part[1:], part[:-1]))
        return np.append(True, other.to_numpy(zero_copy_only=False))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        new = starts_of(rows)
        end = int(np.flatnonzero(new)[-1])
        if end:
            yield one(rows.slice(0, end), new[:end])
        last = rows.slice(end)
    if last is not None:
        yield one(last, starts_of(last))


def _words(df: DataFrame, block_rows: int, row_id: str) -> DataFrame:
    """token, part, blocks: the words of the table, in several rows each, of several tasks."""
    text = search_text(df, [c for c in df.columns if c != row_id]).cast("binary")
    block = F.floor(quoted(row_id) / block_rows).cast("long")
    return df.where(quoted(row_id).isNotNull()).select(block.alias("block"), text.alias("text")).mapInArrow(_cut(runs_pattern()), "token string, part long, blocks array<long>")


def _gathered(dealt: DataFrame) -> DataFrame:
    """token, part, blocks, first: each word once for a part, in order within a partition; all rows of a word must lie in one."""
    return dealt.sortWithinPartitions("token", "part").mapInArrow(_merged, "token string, part long, blocks array<long>, first boolean")


def index_rows(df: DataFrame, block_rows: int = BLOCK_ROWS, row_id: str = "row_id") -> DataFrame:
    """token, part, blocks: each word of the table with the blocks of rows that have it, a row for ``PART`` blocks.

    A task hands on a word with all the blocks that it holds of it, so that a shuffle has few rows for a word where blocks lie together.
    """
    return _gathered(_words(df, block_rows, row_id).repartition("token")).drop("first")


def index_grams(words: DataFrame) -> DataFrame:
    """gram, token: the stretches of one to ``GRAM`` characters of each word of an index, each once."""
    size = F.char_length("token")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(F.col("token"), i, F.lit(n)))
    grams = F.array_distinct(F.concat(*[F.when(size >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]))
    return words.select("token").distinct().select(F.explode(grams).alias("gram"), "token")


def index_stretches(words: DataFrame) -> DataFrame:
    """gram, at, token: the ``GRAM`` characters from each place of a word of an index, fewer at its end.

    Each shorter stretch of a word is the start of one of these, so that they are a third of ``index_grams``.
    """
    return _named(_stretches(words))


def _stretches(words: DataFrame) -> DataFrame:
    """code, at, token: the stretches, with one number for the characters in their order."""
    once = words.where("first").select("token") if "first" in words.columns else words.select("token").distinct()
    return once.mapInArrow(_coded, "code long, at int, token string")


def _named(stretches: DataFrame) -> DataFrame:
    return stretches.select(F.substring(F.col("token"), F.col("at"), F.lit(GRAM)).alias("gram"), "at", "token")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        token = batch.column(0)
        sizes = pc.utf8_length(token).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(token.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]
        code = points << 21 * (GRAM - 1)
        for k in range(1, GRAM):
            code |= np.where(at + k < sizes[of], np.roll(points, -k), 0) << 21 * (GRAM - 1 - k)
        ends = np.cumsum(pc.binary_length(token).to_numpy()[of], dtype=np.int64) // PIECE
        for rows in np.split(np.arange(len(of)), np.flatnonzero(np.diff(ends)) + 1):
            yield pa.RecordBatch.from_arrays([pa.array(code[rows]), pa.array(at[rows] + 1, pa.int32()), token.take(pa.array(of[rows]))], ["code", "at", "token"])


def build_index(df: DataFrame, path: str, block_rows: int = BLOCK_ROWS, row_id: str = "row_id") -> None:
    """Writes the data sorted by row number, so that blocks are ranges of pages, the words and the grams sorted by themselves, and a note."""
    spark = df.sparkSession
    df.repartitionByRange(quoted(row_id)).sortWithinPartitions(row_id).write.mode("errorifexists").parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    # Drawing the bounds of ranges reads a table once more; the words, cut once, are written for that.
    _words(data, block_rows, row_id).write.mode("errorifexists").parquet(f"{path}/runs")
    _gathered(spark.read.parquet(f"{path}/runs").repartitionByRange("token")).write.mode("errorifexists").parquet(f"{path}/words")
    delete(spark, f"{path}/runs")
    # A sort by one number compares nothing else.
    stretches = _stretches(spark.read.parquet(f"{path}/words")).repartitionByRange("code", "token").sortWithinPartitions("code")
    _named(stretches).write.mode("errorifexists").parquet(f"{path}/grams")
    note = data.agg((F.floor(F.max(quoted(row_id)) / block_rows).cast("long") + 1).alias("blocks"))
    note.select(F.lit(row_id).alias("row_id"), F.lit(block_rows).cast("long").alias("block_rows"), F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks")).write.parquet(f"{path}/note")


def runs_of(query: str) -> list[str]:
    """The runs of word characters of a query; each must lie inside some word of a row."""
    return sorted({r for t in terms_of(query) for r in re.findall(runs_pattern(), t)})


def _gram_of(run: str) -> str:
    """The gram of a run by which its words are looked up: the one with the fewest common letters."""
    grams = [run[i : i + GRAM] for i in range(max(1, len(run) - GRAM + 1))]
    return min(grams, key=lambda g: sum(c in COMMON for c in g))


def words_with(grams: DataFrame, runs: list[str], most: int = WORDS) -> dict[str, list[str]]:
    """For each run the words that it lies inside, by one gram of each; runs with more than ``most`` words are left out.

    The grams are those of ``index_grams``, or of ``index_stretches``, where a word counts at the first place of the gram.
    """
    placed = "at" in grams.columns

    def one(run: str) -> DataFrame:
        g = _gram_of(run)
        here = F.col("gram").startswith(g) if placed and len(g) < GRAM else F.col("gram") == g
        first = F.instr("token", g) == F.col("at") if placed else F.lit(True)
        return grams.where(here & first & F.col("token").contains(run)).select(F.lit(run).alias("run"), "token").limit(most + 1)

    found: dict[str, list[str]] = {run: [] for run in runs}
    for r in reduce(lambda a, b: a.unionAll(b), map(one, runs)).collect():  # most + 1 rows for each run
        found[r["run"]].append(r["token"])
    return {run: sorted(tokens) for run, tokens in found.items() if len(tokens) <= most}


def _any(terms: list[Column]) -> Column:
    """Whether one of the terms holds; a tree of few levels, which a scan of Parquet takes over."""
    while len(terms) > 1:
        terms = [terms[i] | terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(False)


def blocks_with(words: DataFrame, found: dict[str, list[str]]) -> DataFrame:
    """block: those that have a word of each run; reads only where these words lie."""
    tokens = sorted({t for ts in found.values() for t in ts})
    held = words.where(_any([F.col("token") == t for t in tokens]) if len(tokens) <= 100 else F.col("token").isin(tokens))
    of = {t: [k for k, run in enumerate(sorted(found)) if t in found[run]] for t in tokens}
    which = F.create_map(*[x for t, ks in of.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))]) if tokens else F.create_map().cast("map<string,array<int>>")
    pairs = held.select("blocks", F.explode(F.element_at(which, F.col("token"))).alias("run")).select("run", F.explode("blocks").alias("block")).distinct()
    if len(found) == 1:
        return pairs.select("block")
    return pairs.groupBy("block").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") == len(found)).select("block")


def candidate_blocks(index: DataFrame, query: str) -> DataFrame | None:
    """The blocks that can hold every term; None if the query has no word characters to go by."""
    runs = runs_of(query)
    if not runs:
        return None
    which = F.array_compact(F.array(*[F.when(F.col("token").contains(r), F.lit(k)) for k, r in enumerate(runs)]))
    hit = reduce(lambda a, b: a | b, [F.col("token").contains(r) for r in runs])
    found = index.where(hit).select(F.explode(which).alias("run"), "blocks").select("run", F.explode("blocks").alias("block")).distinct()
    return found.groupBy("block").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") == len(runs)).select("block")


def ranges_of(blocks: DataFrame, block_rows: int) -> list[tuple[int, int]]:
    """Ranges of row numbers that hold all the blocks, ``RANGES`` at most: blocks far apart lie in ranges of their own."""
    ends = blocks.agg(F.min("block").alias("lo"), F.max("block").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        return []
    if ends["n"] <= RANGES:
        found = [(r["block"], r["block"]) for r in blocks.collect()]  # RANGES rows at most
    else:
        step = -(-(ends["hi"] - ends["lo"] + 1) // RANGES)
        cut = blocks.groupBy(F.floor((F.col("block") - ends["lo"]) / step).alias("at")).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
        found = [(r["lo"], r["hi"]) for r in cut.collect()]  # RANGES rows at most
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], hi
        else:
            out.append((lo, hi))
    return [(lo * block_rows, (hi + 1) * block_rows - 1) for lo, hi in out]


def search_indexed(data: DataFrame, index: DataFrame, query: str, columns: list[str] | None = None, block_rows: int = BLOCK_ROWS, row_id: str = "row_id") -> DataFrame:
    """The rows that ``search`` finds, reading only ranges of row numbers that hold the blocks which the index leaves.

    The ranges are a filter on the row number that reaches the scan; data in its order is read only there.
    """
    names = [c for c in columns or data.columns if c != row_id]
    blocks = candidate_blocks(index, query)
    if blocks is not None:
        inside = [quoted(row_id).between(lo, hi) for lo, hi in ranges_of(blocks, block_rows)]
        data = data.where(reduce(lambda a, b: a | b, inside, F.lit(False)))
    return search(data, query, names)


def _close(blocks: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges that hold all the blocks, ``most`` at most: cut at the widest gaps."""
    blocks = sorted(blocks)
    gaps = sorted(((b - a, k) for k, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False)) if b > a + 1), reverse=True)[: most - 1]
    ends = [-1, *sorted(k for _, k in gaps), len(blocks) - 1]
    return [(blocks[i + 1], blocks[j]) for i, j in zip(ends, ends[1:], strict=False)] if blocks else []


class TextIndex:
    """A written index, opened once: searches look up words by grams, blocks by words, and rows by ranges of blocks."""

    def __init__(self, spark: SparkSession, path: str):
        note = spark.read.parquet(f"{path}/note").first()
        self.row_id, self.block_rows, self.blocks = note["row_id"], note["block_rows"], note["blocks"]
        self.data, self.words, self.grams = (spark.read.parquet(f"{path}/{name}") for name in ("data", "words", "grams"))

    def ranges(self, query: str) -> list[tuple[int, int]] | None:
        """Ranges of blocks that can have a row of the query; None if the whole table is to be read."""
        runs = runs_of(query)
        found = words_with(self.grams, runs) if runs else {}
        if not found:
            return None
        if not all(found.values()):
            return []
        held = blocks_with(self.words, found)
        blocks = [r["block"] for r in held.limit(BLOCKS + 1).collect()]
        if len(blocks) > BLOCKS:
            ranges = [(lo // self.block_rows, hi // self.block_rows) for lo, hi in ranges_of(held, self.block_rows)]
        else:
            ranges = _close(blocks)
        return None if sum(hi - lo + 1 for lo, hi in ranges) > SHARE * self.blocks else ranges

    def search(self, query: str, columns: list[str] | None = None) -> DataFrame:
        """The rows that ``search`` finds in the data."""
        names = [c for c in columns or self.data.columns if c != self.row_id]
        ranges, n = self.ranges(query), self.block_rows
        data = self.data
        if ranges is not None:
            data = data.where(_any([quoted(self.row_id).between(lo * n, (hi + 1) * n - 1) for lo, hi in ranges]))
        return search(data, query, names)


def search_index(spark: SparkSession, path: str, query: str, columns: list[str] | None = None) -> DataFrame:
    return TextIndex(spark, path).search(query, columns)
