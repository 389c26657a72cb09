"""Text columns: O-80 to O-94."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import METRICS, PRESETS, TRANSFORMS, strip
from ..functions.values import as_text, dtype, quoted, replacement, size_of, unicode, words_of


def _text(df: DataFrame, column: str):
    return as_text(quoted(column), dtype(df, column))


def extract_pattern(df: DataFrame, column: str, new_column: str, preset: str | None = None, pattern: str | None = None, all: bool = True) -> DataFrame:  # noqa: A002
    """All matches as a list, or the first or null; a pattern wins over a preset."""
    if not pattern and preset not in PRESETS:
        raise ValueError(f"give a pattern, or a preset out of {', '.join(PRESETS)}")
    p = F.lit(unicode(pattern or PRESETS[preset]))
    text = _text(df, column)
    return df.withColumn(new_column, F.regexp_extract_all(text, p, F.lit(0)) if all else F.regexp_substr(text, p))


def text_metric(df: DataFrame, column: str, metric: str, new_column: str | None = None) -> DataFrame:
    dt = dtype(df, column)
    name = new_column or f"{column}_{metric}"
    if metric == "length":
        return df.withColumn(name, size_of(quoted(column), dt))
    if metric == "word_count":
        return df.withColumn(name, words_of(quoted(column), dt))
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return df.withColumn(name, METRICS[metric](as_text(quoted(column), dt)))


def transform_text(df: DataFrame, column: str, operation: str, new_column: str | None = None) -> DataFrame:
    if operation not in TRANSFORMS:
        raise ValueError(f"unknown operation {operation!r}; known are {', '.join(TRANSFORMS)}")
    return df.withColumn(new_column or column, TRANSFORMS[operation](_text(df, column)))


def replace_text(df: DataFrame, column: str, pattern: str, replace_with: str = "", literal: bool = True, new_column: str | None = None) -> DataFrame:
    text = _text(df, column)
    new = F.replace(text, F.lit(pattern), F.lit(replace_with)) if literal else F.regexp_replace(text, unicode(pattern), replacement(replace_with))
    return df.withColumn(new_column or column, new)


def split_text(df: DataFrame, column: str, new_column: str, separator: str = ",") -> DataFrame:
    """Pieces between separators, stripped."""
    quoted_separator = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return df.withColumn(new_column, F.transform(F.split(_text(df, column), quoted_separator, -1), strip))
