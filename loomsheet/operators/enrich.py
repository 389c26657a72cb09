"""Tags, scores and buckets: O-95 to O-99."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..functions.values import as_text, dtype, quoted


def keyword_tag(df: DataFrame, column: str, new_column: str, categories: dict[str, list[str]], default: str = "other", multi: bool = False) -> DataFrame:
    """The first label with a keyword in the text, or a list of all such labels."""
    text = as_text(quoted(column), dtype(df, column))
    found = {label: F.coalesce(contains_any(text, words, False), F.lit(False)) for label, words in categories.items() if words}
    if multi:
        labels = [F.when(hit, F.lit(label)) for label, hit in found.items()]
        return df.withColumn(new_column, F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>"))
    tag = F.lit(default)
    for label, hit in reversed(found.items()):
        tag = F.when(hit, F.lit(label)).otherwise(tag)
    return df.withColumn(new_column, tag)


def keyword_score(df: DataFrame, column: str, new_column: str, weights: dict[str, float]) -> DataFrame:
    """Sum of each keyword's count, without overlaps, times its weight."""
    text = F.lower(as_text(quoted(column), dtype(df, column)))
    total = F.lit(0.0)
    for word, weight in weights.items():
        if word:
            count = (F.char_length(text) - F.char_length(F.replace(text, F.lit(word.lower())))) / len(word)
            total = total + F.coalesce(F.round(count), F.lit(0.0)) * float(weight)
    return df.withColumn(new_column, total)


def weighted_score(df: DataFrame, weights: dict[str, float], new_column: str = "score") -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.coalesce(_number(df, c), F.lit(0.0)) * float(w) for c, w in weights.items()], F.lit(0.0))
    return df.withColumn(new_column, total)


def _number(df: DataFrame, column: str):
    dtype(df, column)
    return quoted(column).try_cast("double")


def completeness_score(df: DataFrame, new_column: str = "completeness", columns: list[str] | None = None) -> DataFrame:
    """The share of values that aren't empty, plus up to one for the length of them all."""
    columns = columns or df.columns
    texts = [as_text(quoted(c), dtype(df, c)) for c in columns]
    full = reduce(lambda a, t: a + F.when(F.char_length(t) > 0, 1).otherwise(0), texts, F.lit(0))
    size = reduce(lambda a, t: a + F.coalesce(F.char_length(t), F.lit(0)), texts, F.lit(0))
    return df.withColumn(new_column, full / F.lit(float(len(columns))) + F.least(F.lit(1.0), F.log10(size + 1.0) / 6.0))


def bucketize(df: DataFrame, column: str, breaks: list[float], new_column: str, labels: list[str] | None = None) -> DataFrame:
    """Ranges that hold their upper end; without labels they are called like ``(18, 65]``."""
    breaks = sorted(breaks)
    if labels is None:
        shown = ["-inf", *[f"{b:g}" for b in breaks], "inf"]
        labels = [f"({a}, {b}]" for a, b in zip(shown, shown[1:], strict=False)]
    if len(labels) != len(breaks) + 1:
        raise ValueError(f"{len(breaks)} breaks make {len(breaks) + 1} ranges, not {len(labels)}")
    v = _number(df, column)
    tag = F.when(v.isNull(), F.lit(None).cast("string"))
    for b, label in zip(breaks, labels, strict=False):
        tag = tag.when(v <= float(b), F.lit(label))
    return df.withColumn(new_column, tag.otherwise(F.lit(labels[-1])))


__all__ = ["bucketize", "completeness_score", "keyword_score", "keyword_tag", "weighted_score"]
