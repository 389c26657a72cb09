"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import literal, unicode

# What the presets match.
PRESETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?\d[\d\s().-]{6,}\d",
    "url": r"https?://[^\s\"'<>)\]]+",
    "number": r"-?\d+(?:[.,]\d+)?",
    "hashtag": r"#\w+",
    "mention": r"@\w+",
    "date": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, unicode(r"^\s+|\s+$"), "")


def title(c: Column) -> Column:
    """The first letter of each run of letters and digits upper, the rest lower."""
    runs = F.regexp_extract_all(c, F.lit(unicode(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+")), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


TRANSFORMS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "strip": strip,
    "title": title,
    "collapse_whitespace": lambda c: strip(F.regexp_replace(c, unicode(r"\s+"), " ")),
    "remove_punctuation": lambda c: F.regexp_replace(c, unicode(r"[^\w\s]"), ""),
    "remove_html": lambda c: F.regexp_replace(c, r"<[^>]+>", " "),
    "remove_urls": lambda c: F.regexp_replace(c, unicode(PRESETS["url"]), ""),
    "remove_emails": lambda c: F.regexp_replace(c, unicode(PRESETS["email"]), ""),
}

METRICS = {
    "line_count": lambda c: F.regexp_count(c, F.lit("\n")) + 1,
    "digit_count": lambda c: F.regexp_count(c, F.lit(unicode(r"\d"))),
    "uppercase_ratio": lambda c: F.regexp_count(c, F.lit("[A-Z]")) / F.greatest(F.char_length(c), F.lit(1)),
}


def contains_any(c: Column, keywords: list[str], case_sensitive: bool) -> Column:
    """Whether the text has any of the keywords; many keywords become one pattern."""
    if len(keywords) > 50:
        return c.rlike("|".join(literal(k, not case_sensitive) for k in keywords))
    text = c if case_sensitive else F.lower(c)
    found = F.lit(False)
    for k in keywords:
        found = found | text.contains(k if case_sensitive else k.lower())
    return found
