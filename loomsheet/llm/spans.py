"""Places of pattern matches in texts, with built-in column functions only.

Positions are code points, from 0, the end exclusive. ``locate`` finds the leftmost non-overlapping
matches of a Java pattern: ``regexp_extract_all`` gives the matches, ``split`` what lies between
them, and running sums of both lengths give the places. The sums go in blocks of ``BLOCK`` matches,
so that a text with very many matches isn't quadratic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
CONTEXT = 24  # characters kept on either side of a match

NONE = "array<struct<start:int,stop:int,hit:string,before:string,after:string>>"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def locate(df: DataFrame, name: str, pattern: str, guard: Column | None = None, text: str = "text") -> DataFrame:
    """Adds ``name``: an array of (start, stop, hit, before, after), in order. ``guard`` false means no match."""
    hits, parts, sums = f"{name}__hits", f"{name}__parts", f"{name}__sums"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<string>")
    df = df.withColumn(hits, found if guard is None else F.when(guard, found).otherwise(empty))
    df = df.withColumn(parts, F.when(F.size(hits) > 0, F.split(text, pattern, -1)))
    steps = F.zip_with(F.col(parts), F.col(hits), lambda p, h: F.char_length(p) + F.coalesce(F.char_length(h), F.lit(0)))
    df = df.withColumn(sums, F.when(F.size(hits) > 0, steps))
    n = F.size(hits)
    # The sum of all before each block, then within the block.
    blocks = F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / F.lit(BLOCK)).cast("int")),
        F.array(F.lit(0)),
        lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + _sum(F.slice(F.col(sums), b * BLOCK + 1, F.lit(BLOCK))))),
    )
    df = df.withColumn(f"{name}__blocks", F.when(n > 0, blocks))

    def place(i: Column) -> Column:
        block = F.floor(i / F.lit(BLOCK)).cast("int")
        before = F.get(F.col(f"{name}__blocks"), block) + _sum(F.slice(F.col(sums), block * BLOCK + 1, i - block * BLOCK))
        piece, hit, after = F.get(F.col(parts), i), F.get(F.col(hits), i), F.get(F.col(parts), i + 1)
        start = before + F.char_length(piece)
        return F.struct(
            start.alias("start"), (start + F.char_length(hit)).alias("stop"), hit.alias("hit"), F.right(piece, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after")
        )

    whole = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), place)).otherwise(F.array().cast(NONE))
    return df.withColumn(name, whole).drop(hits, parts, sums, f"{name}__blocks")


def those(spans: str, wanted: Callable[[Column], Column]) -> Column:
    """The spans of a column whose text is ``wanted``."""
    return F.filter(spans, lambda s: wanted(s["hit"]))


MASK = "\x01"  # stands for each character that is cut out; no pattern of this folder matches it


def masked(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None, mask: Column | None = None) -> Column:
    """The text with each character of the matches, or of those that are ``wanted``, replaced by ``mask``, by default ``MASK``."""
    gone = lambda h: F.repeat(F.lit(MASK) if mask is None else mask, F.char_length(h))
    hit = lambda h: gone(h) if wanted is None else F.when(wanted(h), gone(h)).otherwise(h)
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.concat(p, F.coalesce(hit(h), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def bound(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these columns as results of a generator, so that no filter further up evaluates them again."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names)))).select(df.columns)


def bare(spans: Column, kind: int) -> Column:
    """(kind, start, stop) of spans."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
