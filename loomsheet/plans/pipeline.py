"""Pipelines of named steps over a DataFrame (O-59)."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rows import limit_rows
from ..streaming.guard import check_streaming
from .registry import FUNCTIONS

PREVIEW, SHOWN = 200, 20
_LISTS = ("columns", "by", "keywords", "breaks", "order_by")
_NAMES = ("column", "columns", "by")


def resolve(df: DataFrame, op: str, params: dict) -> dict:
    """Parameters checked against the function and the columns at this step; one column stands for a list."""
    if op not in FUNCTIONS:
        raise ValueError(f"there is no function {op!r}")
    spec, given = FUNCTIONS[op], dict(params)
    known = spec.params
    free = any(p.kind is inspect.Parameter.VAR_KEYWORD for p in known.values())
    if not free and (extra := set(given) - set(known)):
        raise ValueError(f"unknown parameters: {', '.join(sorted(extra))}")
    missing = [k for k, p in known.items() if p.default is inspect.Parameter.empty and p.kind is not inspect.Parameter.VAR_KEYWORD and given.get(k) is None and k not in given]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    for k in _LISTS:
        if isinstance(given.get(k), str):
            given[k] = [given[k]]
    for k in _NAMES:
        if k in known and given.get(k):
            for c in [given[k]] if isinstance(given[k], str) else given[k]:
                if c not in df.columns:
                    raise ValueError(f"there is no column {c!r}; the columns are {', '.join(df.columns)}")
    return given


def run_pipeline(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Folds the steps, each {op, params}; an error names its step."""
    for k, step in enumerate(steps, 1):
        op = step.get("op", "?")
        try:
            params = resolve(df, op, step.get("params", {}))
            check_streaming(df, op, params)
            df = FUNCTIONS[op].fn(df, **params)
        except Exception as e:
            raise ValueError(f"Step {k} ({op}): {e}") from e
    return df


def preview(df: DataFrame, steps: list[dict], order_by: list[str] | None = None) -> dict:
    """The first rows through the steps: {columns, rows (``SHOWN`` at most), total}."""
    first = limit_rows(df, PREVIEW, order_by) if order_by else df.limit(PREVIEW)
    out = run_pipeline(first, steps)
    # No more than PREVIEW rows go in, so the result is small unless a step multiplies rows.
    return {"columns": out.columns, "rows": [r.asDict(recursive=True) for r in out.take(SHOWN)], "total": out.agg(F.count(F.lit(1))).first()[0]}
