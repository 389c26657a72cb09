"""Repeated and late events by key: on a stream with state that the watermark bounds, on a table as a plain aggregate (O-110)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import quoted, unused


def dedupe(df: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """One row for each combination of keys. On a stream repeats are known for ``late`` after the first, and the state goes then."""
    if df.isStreaming:
        return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def first_of_key(df: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The earliest row by ``time`` of each key; of rows at one time, the one that orders first by all columns.

    On a stream a key's row comes out once the watermark, which is ``late`` behind the newest event, has passed its time by
    ``late``: no event that may still come can be earlier. Later events are dropped by the watermark, the state holds one
    row for each open key and goes with the row; a key whose events lie further apart than twice ``late`` comes again.
    Rows without a key or a time are left out.
    """
    names = df.columns
    held = df.where(quoted(key).isNotNull() & quoted(time).isNotNull())
    order = F.struct(quoted(time), *[quoted(c) for c in names if c != time])
    if not df.isStreaming:
        row = F.min(order).alias(unused("__row", names))
        first = held.groupBy(quoted(key).alias(unused("__key", names))).agg(row)
        return first.select(f"{unused('__row', names)}.*").select([quoted(c) for c in names])
    schema = df.schema
    wait = int(df.sparkSession.sql(f"SELECT (timestamp '1970-01-01' + interval {late}) - timestamp '1970-01-01' AS w").first()["w"].total_seconds() * 1000)
    state_schema = T.StructType([T.StructField("row", schema), T.StructField("at", T.LongType())])

    def earliest(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            row, _ = state.get
            state.remove()
            yield pd.DataFrame([list(row)], columns=names)
            return
        best = tuple(state.get[0]) if state.exists else None
        place = [names.index(time), *[k for k, c in enumerate(names) if c != time]]
        rank = lambda r: [(r[k] is not None and r[k] == r[k], r[k] if r[k] == r[k] else 0) for k in place]  # noqa: E731  null and NaN first, as a struct orders
        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                if best is None or rank(row) < rank(best):
                    best = row
        at = int(pd.Timestamp(best[names.index(time)]).value // 10**6)
        state.update((best, at))
        state.setTimeoutTimestamp(max(at + wait, state.getCurrentWatermarkMs() + 1))
        yield from ()

    return held.withWatermark(time, late).groupBy(quoted(key)).applyInPandasWithState(earliest, schema, state_schema, "append", "EventTimeTimeout")
