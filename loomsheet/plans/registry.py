"""The library of table functions by name, with their parameters (O-58)."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import columns, enrich, reshape, rows, text

ROW_WISE, WHOLE = "row", "table"


@dataclass(frozen=True)
class Spec:
    """A function (df, **params) -> df. ``scope`` says whether it looks at one row or at the whole table."""

    name: str
    fn: Callable[..., DataFrame]
    category: str
    scope: str

    @property
    def params(self) -> dict[str, inspect.Parameter]:
        return dict(list(inspect.signature(self.fn).parameters.items())[1:])

    @property
    def text(self) -> str:
        return (self.fn.__doc__ or self.name.replace("_", " ")).strip().splitlines()[0]


    @property
    def output(self) -> str:
        return _OUTPUTS.get(self.category, "a table")

    @property
    def example(self) -> dict:
        """A step that calls the function, with a value for each parameter that has no default."""
        needed = [k for k, p in self.params.items() if p.default is inspect.Parameter.empty]
        return {"op": self.name, "params": {k: _SAMPLES.get((self.name, k), _SAMPLES.get(k, "...")) for k in needed}}


_OUTPUTS = {
    "rows": "the same columns, fewer rows or rows in another order", "columns": "the same rows, columns chosen or changed", "text": "the same rows, a column of text changed or added",
    "text and structure": "the same rows, columns put together or taken apart", "reshape": "a row for each group, value or item", "enrich": "the same rows and a new column", "flags": "the same rows and a column of true and false",
}
_SAMPLES = {
    "column": "text", "columns": ["text", "lang"], "operator": "is_not_null", "keywords": ["spark", "sql"], "n": 10, "mapping": {"text": "body"}, "dtype_name": "integer", "strategy": "forward", "new_column": "found",
    "metric": "word_count", "operation": "lowercase", "pattern": r"\s+", "path": "user.name", "by": ["lang"], "agg": "count", "categories": {"sport": ["football"], "finance": ["stock"]}, "weights": {"good": 1.0, "bad": -1.0},
    "breaks": [10.0, 100.0], ("weighted_score", "weights"): {"n_chars": 1.0}, ("replace_values", "mapping"): {"en": "english"}, ("bucketize", "column"): "n_chars",
}

_BUILT_IN = {
    "rows": (rows, {"filter_rows": ROW_WISE, "filter_range": ROW_WISE, "filter_keywords": ROW_WISE, "drop_nulls": ROW_WISE, "dedupe": WHOLE, "sort_rows": WHOLE, "top_n": WHOLE, "limit_rows": WHOLE, "sample_rows": WHOLE}),
    "columns": (
        columns,
        {"select_columns": ROW_WISE, "drop_columns": ROW_WISE, "rename_columns": ROW_WISE, "cast_column": ROW_WISE, "fill_missing": WHOLE, "replace_values": ROW_WISE},
    ),
    "text": (text, {"extract_pattern": ROW_WISE, "text_metric": ROW_WISE, "transform_text": ROW_WISE, "replace_text": ROW_WISE, "split_text": ROW_WISE}),
    "text and structure": (columns, {"concat_columns": ROW_WISE, "extract_field": ROW_WISE, "unnest_struct": ROW_WISE}),
    "reshape": (reshape, {"explode_list": ROW_WISE, "group_aggregate": WHOLE, "value_counts": WHOLE}),
    "enrich": (enrich, {"keyword_tag": ROW_WISE, "keyword_score": ROW_WISE, "weighted_score": ROW_WISE, "completeness_score": ROW_WISE, "bucketize": ROW_WISE}),
    "flags": (rows, {"flag_rows": ROW_WISE}),
}

FUNCTIONS: dict[str, Spec] = {name: Spec(name, getattr(module, name), category, scope) for category, (module, names) in _BUILT_IN.items() for name, scope in names.items()}


def register(name: str, fn: Callable[..., DataFrame], category: str = "own", scope: str = WHOLE) -> Spec:
    """Adds a function of one's own, (df, **params) -> df, to pipelines."""
    if name in FUNCTIONS and FUNCTIONS[name].category != "own":
        raise ValueError(f"{name!r} is built in")
    FUNCTIONS[name] = Spec(name, fn, category, scope)
    return FUNCTIONS[name]
