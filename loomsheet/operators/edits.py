"""Row edits as table operations: O-60 to O-66b.

An edit list holds ops in order: {"op": "add", "row": {...}}, {"op": "update", "row_id": i, "values": {...}},
{"op": "delete", "row_id": i}, {"op": "replace", ...}, {"op": "transform", "steps": [...]}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import coerced, dtype, kind, literal, quoted, typed, unicode, unused, verbatim
from ..functions.values import replacement as translated
from ..plans.pipeline import run_pipeline
from ..sources.rowid import number_rows

ADDED = 2**40
BROADCAST = 100_000  # changed rows up to which the changes are broadcast


def _match(df: DataFrame, column: str, find, mode: str, ignore_case: bool) -> Column:
    dt, c = dtype(df, column), quoted(column)
    if mode == "exact":
        if find is None:
            return c.isNull()
        if isinstance(dt, T.StringType) and ignore_case:
            return F.coalesce(F.lower(c) == str(find).lower(), F.lit(False))
        return F.coalesce(c == F.lit(typed(find, dt)), F.lit(False))
    if not isinstance(dt, T.StringType):
        raise ValueError(f"{mode} needs a text column, {column!r} is {kind(dt)}")
    pattern = literal(str(find), ignore_case) if mode == "contains" else unicode(str(find), ignore_case)
    return F.coalesce(c.rlike(pattern), F.lit(False))


def find_replace(df: DataFrame, column: str, find, replace_with, mode: str = "exact", ignore_case: bool = False) -> DataFrame:
    """exact: the whole value; contains: each occurrence, the new text verbatim; regex: with groups."""
    if mode not in ("exact", "contains", "regex"):
        raise ValueError(f"unknown mode {mode!r}")
    hit, c = _match(df, column, find, mode, ignore_case), quoted(column)
    if mode == "exact":
        return df.withColumn(column, F.when(hit, coerced(replace_with, dtype(df, column))).otherwise(c))
    pattern = literal(str(find), ignore_case) if mode == "contains" else unicode(str(find), ignore_case)
    new = verbatim(str(replace_with)) if mode == "contains" else translated(str(replace_with))
    return df.withColumn(column, F.regexp_replace(c, pattern, new))


def count_matches(df: DataFrame, column: str, find, mode: str = "exact", ignore_case: bool = False) -> DataFrame:
    """One row, matches: how many rows a replacement would change."""
    return df.agg(F.count_if(_match(df, column, find, mode, ignore_case)).alias("matches"))


def _apply_rows(df: DataFrame, run: list[dict], row_id: str) -> DataFrame:
    """Updates and deletes that follow one another, as one join."""
    rows: dict[int, dict | None] = {}
    for op in run:
        key = int(op["row_id"])
        if op["op"] == "delete":
            rows[key] = None
        elif rows.get(key, {}) is not None:
            rows.setdefault(key, {}).update(op["values"])
    spark = df.sparkSession
    deleted = [(k,) for k, v in rows.items() if v is None]
    if deleted:
        gone = spark.createDataFrame(deleted, f"{row_id} long")
        df = df.join(F.broadcast(gone) if len(deleted) <= BROADCAST else gone, row_id, "left_anti")
    updated = {k: v for k, v in rows.items() if v}
    columns = sorted({c for v in updated.values() for c in v})
    for c in columns:
        dtype(df, c)
    if not updated:
        return df
    # One row for each changed row; a flag tells "set to null" from "not set".
    own, was_set, new = (unused(name, df.columns) for name in ("__id", "__set_", "__new_"))
    fields = [T.StructField(own, T.LongType())]
    for k, c in enumerate(columns):
        fields += [T.StructField(f"{was_set}{k}", T.BooleanType()), T.StructField(f"{new}{k}", df.schema[c].dataType)]
    data = [(i, *[x for c in columns for x in ((True, _python(v[c], df.schema[c].dataType)) if c in v else (False, None))]) for i, v in updated.items()]
    changes = spark.createDataFrame(data, T.StructType(fields))
    joined = df.join(F.broadcast(changes) if len(data) <= BROADCAST else changes, quoted(row_id) == F.col(own), "left")
    at = {c: k for k, c in enumerate(columns)}
    return joined.select(*[F.when(F.col(f"{was_set}{at[c]}"), F.col(f"{new}{at[c]}")).otherwise(quoted(c)).alias(c) if c in at else quoted(c) for c in df.columns])


def _python(value, dt: T.DataType):
    """An edited value as Python's value of the column's type."""
    if value is None or not isinstance(value, str):
        if isinstance(dt, (T.DoubleType, T.FloatType)) and isinstance(value, int):
            return float(value)
        if isinstance(dt, T.StringType) and value is not None:
            return str(value)
        return value
    out = typed(value, dt)
    if isinstance(out, str) and kind(dt) in ("integer", "float", "boolean"):
        raise ValueError(f"{value!r} is not a value of type {kind(dt)}")
    if kind(dt) in ("date", "datetime"):
        import datetime

        moment = datetime.datetime.fromisoformat(value)
        return moment.date() if kind(dt) == "date" else moment
    return out


def _add(df: DataFrame, rows: list[dict], row_id: str, start: int) -> DataFrame:
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    for r in rows:
        for c in r:
            dtype(df, c)
    data = [tuple(start + k if f.name == row_id else _python(r.get(f.name), f.dataType) for f in schema) for k, r in enumerate(rows)]
    return df.unionByName(df.sparkSession.createDataFrame(data, schema))


def apply_changes(df: DataFrame, ops: list[dict], row_id: str = "row_id", start: int = ADDED) -> DataFrame:
    """The table after all edits in order. Added rows come last, with numbers from ``start``, by default 2**40."""
    run: list[dict] = []
    added = 0

    def flush(df: DataFrame) -> DataFrame:
        nonlocal run
        out = _apply_rows(df, run, row_id) if run else df
        run = []
        return out

    for op in ops:
        if op["op"] in ("update", "delete"):
            run.append(op)
            continue
        df = flush(df)
        if op["op"] == "add":
            rows = op["rows"] if "rows" in op else [op["row"]]
            df, added = _add(df, rows, row_id, start + added), added + len(rows)
        elif op["op"] == "replace":
            df = find_replace(df, op["column"], op["find"], op["replace"], op.get("mode", "exact"), op.get("ignore_case", False))
        elif op["op"] == "transform":
            df = transform_rows(df, op["steps"], row_id)
            added = 0
        else:
            raise ValueError(f"unknown edit {op['op']!r}")
    return flush(df)


def transform_rows(df: DataFrame, steps: list[dict], row_id: str = "row_id") -> DataFrame:
    """Runs steps as an edit, then numbers the rows anew: by the last sort's keys, else by their old order."""
    out = run_pipeline(df, steps)
    order, descending = [row_id], False
    for step in steps:
        if step["op"] == "sort_rows":
            params = step["params"]
            order, descending = params["columns"] if isinstance(params["columns"], list) else [params["columns"]], params.get("descending", False)
    if row_id not in out.columns:
        return number_rows(out, out.columns, row_id)
    if order == [row_id]:
        return number_rows(out, [row_id], row_id)
    # Ties keep the old order, also when the sort is descending.
    out = out.withColumn("__tie", -F.col(row_id) if descending else F.col(row_id))
    return number_rows(out, [*order, "__tie"], row_id, descending).drop("__tie")


def apply_change_table(df: DataFrame, changes: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Many edits from a table (seq, row_id, op, column, value): update with value as text, or delete.

    Folded for each row and column by the last ``seq``; an update after a delete of its row is ignored.
    """
    gone = changes.where("op = 'delete'").groupBy(row_id).agg(F.min("seq").alias("gone"))
    last = changes.where("op = 'update'").groupBy(row_id, "column").agg(F.max_by(F.struct("value"), "seq").alias("new"))
    held = last.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("column", F.col("new.value").alias("value")))).alias("__new"))  # at most one entry for each column
    kept = df.join(gone.select(row_id), row_id, "left_anti").join(held, row_id, "left")

    def value(c: str) -> Column:
        new = F.element_at("__new", F.lit(c))
        return F.when(F.coalesce(F.map_contains_key("__new", c), F.lit(False)), new.try_cast(df.schema[c].dataType)).otherwise(quoted(c)).alias(c)

    return kept.select(*[quoted(c) if c == row_id else value(c) for c in df.columns])


def change_table(df: DataFrame, ops: list[dict], row_id: str = "row_id") -> DataFrame:
    """seq, op, row_id, label: a row for each edit, with what it does in words; edits of many rows have no row_id."""

    def label(op: dict) -> str:
        what = op["op"]
        if what == "update":
            return f"Row {op['row_id']}: set {', '.join(f'{c} to {v}' for c, v in op['values'].items())}"
        if what == "delete":
            return f"Row {op['row_id']}: deleted"
        if what == "add":
            return f"Added {len(op.get('rows', [None]))} row(s)"
        if what == "replace":
            return f"{op['column']}: replaced {op['find']} by {op['replace']}"
        return "Ran " + ", ".join(step["op"] for step in op.get("steps", []))

    rows = [(k, op["op"], op.get("row_id"), label(op)) for k, op in enumerate(ops)]
    return df.sparkSession.createDataFrame(rows, f"seq int, op string, {row_id} long, label string")


def change_summary(df_changes: DataFrame) -> DataFrame:
    """op, changes, rows: how many edits of each kind, of how many rows."""
    return df_changes.groupBy("op").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("row_id").alias("rows"))
