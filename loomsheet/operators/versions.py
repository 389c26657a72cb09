"""Versions of tables: deltas in tiers, commits that survive, checkout, restore, diff: O-67 to O-69."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce
from threading import Lock

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import quoted, unused
from ..sources import buckets
from ..sources.rowid import number_rows
from ..sources.shared import bytes_under, delete
from .edits import ADDED, BROADCAST, apply_changes

FAN = 8  # deltas, or runs of a tier, that become one run
FILES = 8  # of a run
SMALL = 32 << 20  # bytes of runs up to which they are broadcast
SHARE, LEAST = 0.5, 8 << 20  # of a whole table's bytes, and bytes at least, from which a new one is written


def build_undo(parent: DataFrame, child: DataFrame, touched: list[str] | None = None, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """What leads from ``child`` back to ``parent``: deleted rows, and the old cells of changed rows.

    cells has, for each touched column c, ``c`` (the old value) and ``c__changed``; untouched columns aren't read.
    """
    touched = [c for c in touched or parent.columns if c != row_id and c in child.columns]
    deleted = parent.join(child.select(quoted(row_id)), row_id, "left_anti").select([quoted(c) for c in parent.columns])
    old = parent.select(quoted(row_id), *[quoted(c) for c in touched])
    own = unused("__new_", parent.columns)
    new = child.select(quoted(row_id), *[quoted(c).alias(f"{own}{k}") for k, c in enumerate(touched)])
    differs = {c: ~quoted(c).eqNullSafe(F.col(f"{own}{k}")) for k, c in enumerate(touched)}
    changed = reduce(lambda a, b: a | b, differs.values(), F.lit(False))
    cells = old.join(new, row_id).where(changed)
    return deleted, cells.select(quoted(row_id), *[x for c in touched for x in (F.when(differs[c], quoted(c)).alias(c), differs[c].alias(f"{c}__changed"))])


def delta_counts(deleted: DataFrame, cells: DataFrame, added: DataFrame) -> DataFrame:
    """kind, rows of a delta."""
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "rows")
    return one(deleted, "deleted").unionAll(one(cells, "changed")).unionAll(one(added, "added"))


def apply_undo(child: DataFrame, deleted: DataFrame, cells: DataFrame, row_id: str = "row_id", added: DataFrame | None = None) -> DataFrame:
    """The parent: without added rows, with old cells, and with the deleted rows again. Rows keep their numbers."""
    names = deleted.columns
    if added is not None:
        child = child.join(added.select(quoted(row_id)), row_id, "left_anti")
    old, was = unused("__old_", names), unused("__was_", names)
    touched = [c.removesuffix("__changed") for c in cells.columns if c.endswith("__changed")]
    back = cells.select(quoted(row_id), *[quoted(x).alias(y) for k, c in enumerate(touched) for x, y in ((c, f"{old}{k}"), (f"{c}__changed", f"{was}{k}"))])
    joined = child.join(back, row_id, "left")
    at = {c: k for k, c in enumerate(touched)}
    restored = joined.select(*[F.when(F.coalesce(F.col(f"{was}{at[c]}"), F.lit(False)), F.col(f"{old}{at[c]}")).otherwise(quoted(c)).alias(c) if c in at else quoted(c) for c in names])
    return restored.unionByName(deleted)


def schema_changes(a: DataFrame, b: DataFrame) -> dict[str, list]:
    """Columns of ``b`` that ``a`` lacks, those it lost, and those of another type."""
    old, new = {f.name: f.dataType for f in a.schema}, {f.name: f.dataType for f in b.schema}
    return {
        "added": [c for c in new if c not in old],
        "removed": [c for c in old if c not in new],
        "retyped": [(c, old[c].simpleString(), new[c].simpleString()) for c in old if c in new and old[c] != new[c]],
    }


def row_diff(a: DataFrame, b: DataFrame, row_id: str | None = "row_id") -> DataFrame:
    """Rows of one side that the other lacks, with ``side`` removed or added, over columns of equal name and type.

    Set semantics: a repeated row is no difference. Rows compare null-safely and exactly.
    """
    shared = [f.name for f in a.schema if f.name in b.columns and b.schema[f.name].dataType == f.dataType and f.name != row_id]
    was = unused("__was", shared)
    left, right = (t.select(*[quoted(c) for c in shared], F.lit(old).alias(was)) for t, old in ((a, True), (b, False)))
    return _one_sided(left.unionByName(right), was)


def _one_sided(rows: DataFrame, was: str) -> DataFrame:
    """The rows that only one side has, each once, with ``side``; ``was`` tells the sides apart. Each row goes through one shuffle."""
    names = [c for c in rows.columns if c != was]
    own = unused("__is_", names)
    has = lambda old: F.coalesce(F.bool_or(quoted(was) if old else ~quoted(was)), F.lit(False))
    held = rows.groupBy(*[quoted(c) for c in names]).agg(has(True).alias(f"{own}old"), has(False).alias(f"{own}new"))
    side = F.when(F.col(f"{own}old"), "removed").otherwise("added")
    return held.where(F.col(f"{own}old") != F.col(f"{own}new")).select(*[quoted(c) for c in names], side.alias("side"))


def diff(a: DataFrame, b: DataFrame, row_id: str | None = "row_id", samples: int = 5) -> dict:
    """Schema changes, row counts of either side, and a few different rows of each."""
    rows = row_diff(a, b, row_id)
    counts = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    shown = {side: [r.asDict() for r in rows.where(F.col("side") == side).drop("side").limit(samples).collect()] for side in ("removed", "added")}
    return {"schema": schema_changes(a, b), "row_delta": b.count() - a.count(), "removed": counts.get("removed", 0), "added": counts.get("added", 0), "samples": shown}


@dataclass
class Commit:
    """A version: how it is kept (none for the first, delta, snapshot or replay), the folder of the attempt that made it,
    how many deltas it is from a table, and the runs that end in it."""

    number: int
    message: str
    undo: str
    attempt: str
    depth: int = 0
    whole: int | None = None  # bytes of its whole table, if it has one
    restored: int | None = None
    runs: list[list[int]] = field(default_factory=list)  # for each tier: the version that the run starts from, and its bytes
    edits: int = 0
    tag: str | None = None


class Conflict(RuntimeError):
    """Other writers were faster each time."""


_publishing = Lock()


class Versions:
    """The versions of a table under one folder: whole tables, deltas, and a note for each version.

    A commit of row edits writes the rows that it changed, each as it was and as it is, however large the
    table is. Each ``FAN``-th delta in a line also writes one run of the last ``FAN``, each ``FAN ** 2``-th a run
    of ``FAN`` such runs, and so on, so that a version is a whole table and few runs, and a row is written
    as often as there are tiers. A whole table is written when the runs since the last are more than ``SHARE`` of it.
    Edits that number rows anew write a whole table. A restored version writes nothing but its note. ``clean`` deletes
    whole tables that runs can give again, and what attempts left that never became a version.

    A version is there once its note is: an attempt writes to folders of its own, which the note names, and
    the note is renamed into place, which only one of several writers can do; the others start again on
    the new version. Edits lie in a table beside the rows and are read only when asked for. Whole
    tables are bucketed by row number, so that a join on it shuffles no table. Needs a file system
    whose rename is atomic and doesn't replace.
    """

    def __init__(self, spark: SparkSession, path: str, row_id: str = "row_id"):
        self.spark, self.path, self.row_id = spark, path.rstrip("/"), row_id

    # --- notes

    def _publish(self, folder: str, name: str, record: dict) -> bool:
        """Writes a small file that is either whole or absent; False if there is one of that name."""
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs
        place, unfinished = files.Path(f"{self.path}/{folder}/{name}"), files.Path(f"{self.path}/unfinished/{uuid.uuid4().hex}")
        system = place.getFileSystem(hadoop)
        system.mkdirs(place.getParent())
        out = system.create(unfinished, False)
        out.write(bytearray(json.dumps(record | {"at": time.time_ns()}, default=str).encode()))
        out.close()
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        with _publishing:
            try:
                files.FileContext.getFileContext(system.getUri(), hadoop).rename(unfinished, place, never)
                return True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
        system.delete(unfinished, False)
        return False

    def _records(self, folder: str) -> list[dict]:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not held.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(held):
            return []
        return sorted((json.loads(r[0]) for r in self.spark.read.text(f"{self.path}/{folder}").collect()), key=lambda r: r["at"])  # a line for each note

    def log(self) -> list[Commit]:
        """All commits, the oldest first; reads notes only."""
        held = {r["number"]: Commit(**{k: v for k, v in r.items() if k != "at"}) for r in self._records("notes")}
        for mark in self._records("marks") if held else []:
            for key in ("tag", "whole"):
                if key in mark:
                    setattr(held[mark["number"]], key, mark[key])
        return [held[k] for k in sorted(held)]

    def _find(self, commits: list[Commit], ref: int | str | None) -> Commit:
        if ref is None:
            return commits[-1]
        found = [c for c in commits if ref in (c.number, c.tag)]
        if not found:
            raise ValueError(f"there is no version {ref!r}")
        return found[-1]

    # --- lines of deltas

    def _held(self, commits: list[Commit], commit: Commit) -> Commit:
        """The version that has the rows of a restored one."""
        while commit.undo == "replay":
            commit = commits[commit.restored]
        return commit

    def _run(self, commit: Commit, tier: int) -> str:
        return f"{self.path}/delta/{commit.attempt}/" + ("rows" if tier == 0 else f"run-{tier}")

    def _chain(self, commits: list[Commit], commit: Commit, upto: Commit | None = None) -> tuple[Commit, list[tuple[str, int]]]:
        """Where the line of a version starts, and the (path, bytes) of its runs since, the newest first.

        The line starts at its last whole table, or at the depth of ``upto``.
        """
        found = []
        if upto is None:
            upto = commit
            while upto.whole is None:
                upto = commits[upto.runs[0][0]]
        while commit.depth > upto.depth:
            tier = max(k for k in range(len(commit.runs)) if commit.depth - FAN**k >= upto.depth)
            start, size = commit.runs[tier]
            found.append((self._run(commit, tier), size))
            commit = commits[start]
        return commit, found

    def _meet(self, commits: list[Commit], a: Commit, b: Commit) -> tuple[list[str], list[str]] | None:
        """The runs from ``a`` and from ``b``, each the newest first, back to the last version of both lines; None if there is none."""
        a, back = self._chain(commits, a, b) if a.depth > b.depth else (a, [])
        b, there = self._chain(commits, b, a)
        while a is not b:
            if not a.runs or not b.runs:
                return None
            tier = max((k for k in range(len(a.runs)) if a.runs[k][0] != b.runs[k][0]), default=0)
            back.append((self._run(a, tier), 0))
            there.append((self._run(b, tier), 0))
            a, b = commits[a.runs[tier][0]], commits[b.runs[tier][0]]
        return [p for p, _ in back], [p for p, _ in there]

    def _composed(self, steps: list[tuple[str, bool]]) -> DataFrame:
        """row_id, old, new: each row before the first step and after the last; a step is a run, or a run the other way."""
        parts = []
        for k, (path, forward) in enumerate(steps):
            df = self.spark.read.parquet(path)
            names = ("old", "new") if forward else ("new", "old")
            parts.append(df.select(quoted(self.row_id), F.col(names[0]).alias("old"), F.col(names[1]).alias("new"), F.lit(k).alias("__at")))
        if len(parts) == 1:
            return parts[0].drop("__at")
        # Dealt by row number first: a run has a number once, so that grouping before the shuffle would only sort its rows once more.
        held = reduce(lambda x, y: x.unionByName(y), parts).repartition(quoted(self.row_id)).groupBy(quoted(self.row_id))
        both = held.agg(F.min_by(F.struct("old"), "__at").alias("first"), F.max_by(F.struct("new"), "__at").alias("last"))
        return both.select(quoted(self.row_id), "first.old", "last.new").where(~F.col("old").eqNullSafe(F.col("new")))

    def _table(self, commits: list[Commit], commit: Commit) -> DataFrame:
        start, runs = self._chain(commits, self._held(commits, commit))
        held = buckets.read(self.spark, f"{self.path}/table/{start.attempt}", self.row_id, self._buckets(start))
        if not runs:
            return held
        last = self._composed([(p, True) for p, _ in reversed(runs)])
        if sum(size for _, size in runs) < SMALL:
            last = F.broadcast(last)
            kept = held.join(last.select(quoted(self.row_id)), self.row_id, "left_anti").select(held.columns)
            return kept.unionByName(last.where("new IS NOT NULL").select("new.*").select(held.columns))
        # Both at once, so that the runs are composed once.
        own, new = unused("__id", held.columns), unused("__new", held.columns)
        both = held.join(last.select(quoted(self.row_id).alias(own), F.col("new").alias(new)), quoted(self.row_id) == F.col(own), "full_outer")
        there = both.where(F.col(own).isNull() | F.col(new).isNotNull())
        return there.select(*[F.when(F.col(own).isNull(), quoted(c)).otherwise(F.col(new)[c]).alias(c) for c in held.columns])

    def _buckets(self, commit: Commit) -> int:
        return int(commit.attempt.split("-")[1])

    # --- writing

    def _attempt(self, number: int) -> str:
        return f"{number}-{buckets.buckets_of(self.spark)}-{uuid.uuid4().hex}"

    def _write_whole(self, table: DataFrame, commit: Commit) -> None:
        path = f"{self.path}/table/{commit.attempt}"
        buckets.write(table, path, self.row_id, self._buckets(commit))
        commit.whole = bytes_under(self.spark, path)

    def _forget(self, attempt: str) -> None:
        for folder in ("table", "delta"):
            delete(self.spark, f"{self.path}/{folder}/{attempt}")

    def _next(self, made, tries: int = 8) -> Commit:
        """Publishes what ``made(commits, number)`` gives as the next version; where another writer was faster, makes it anew."""
        for _ in range(tries):
            commits = self.log()
            commit = made(commits, commits[-1].number + 1 if commits else 0)
            record = {k: v for k, v in asdict(commit).items() if k != "tag"}
            if self._publish("notes", f"{commit.number:08d}", record):
                return commit
            self._forget(commit.attempt)
        raise Conflict(f"version {commit.number} was written by others {tries} times")

    def init(self, table: DataFrame, message: str = "first") -> Commit:
        """The first version; the table must have the row number."""

        def made(commits: list[Commit], number: int) -> Commit:
            if commits:
                raise ValueError("there is a first version already")
            commit = Commit(0, message, "none", self._attempt(0))
            self._write_whole(table, commit)
            return commit

        return self._next(made)

    def commit(self, ops: list[dict], message: str = "") -> Commit:
        """Applies edits to the newest version and writes the next."""

        def made(commits: list[Commit], number: int) -> Commit:
            commit = Commit(number, message, "delta", self._attempt(number), edits=len(ops))
            try:
                return self._made(commits, commit, ops)
            except BaseException:
                self._forget(commit.attempt)
                raise

        return self._next(made)

    def _made(self, commits: list[Commit], commit: Commit, ops: list[dict]) -> Commit:
        head = self._held(commits, commits[-1])
        parent = self._table(commits, head)
        start = ADDED * (commit.number + 1)  # numbers of added rows are a commit's own
        lines = [(k, json.dumps(op, default=str)) for k, op in enumerate(ops)]
        self.spark.createDataFrame(lines, "seq int, edit string").coalesce(1).write.parquet(f"{self.path}/delta/{commit.attempt}/edits")
        if any(op["op"] == "transform" for op in ops):
            commit.undo = "snapshot"
            self._write_whole(apply_changes(parent, ops, self.row_id, start), commit)
            return commit
        # Edits of rows keep other columns, so the old row travels beside the new one and nothing is joined.
        was = unused("old", parent.columns)
        row = F.struct(*[quoted(c) for c in parent.columns])
        child = apply_changes(parent.withColumn(was, row), ops, self.row_id, start)
        changed = child.where(quoted(was).isNull() | ~row.eqNullSafe(quoted(was))).select(quoted(self.row_id), quoted(was).alias("old"), row.alias("new"))
        gone = sorted({int(op["row_id"]) for op in ops if op["op"] == "delete"})
        if gone:
            ids = self.spark.createDataFrame([(k,) for k in gone], f"`{self.row_id}` long")
            left = parent.join(F.broadcast(ids) if len(gone) <= BROADCAST else ids, self.row_id, "left_semi")
            changed = changed.unionByName(left.select(quoted(self.row_id), row.alias("old"), F.lit(None).cast(child.select(row.alias("r")).schema["r"].dataType).alias("new")))
        rows = self._run(commit, 0)
        changed.write.parquet(rows)
        commit.depth, commit.runs = head.depth + 1, [[head.number, bytes_under(self.spark, rows)]]
        line = [*commits, commit]
        for tier in range(1, 64):
            if commit.depth % FAN**tier:
                break
            # The run of the tier below that ends here, and those that it follows.
            steps, at = [], commit
            for _ in range(FAN):
                steps.append((self._run(at, tier - 1), True))
                at = line[at.runs[tier - 1][0]]
            run = self._run(commit, tier)
            self._composed(steps[::-1]).coalesce(FILES).write.parquet(run)
            commit.runs.append([at.number, bytes_under(self.spark, run)])
        first, chain = self._chain(line, commit)
        if sum(size for _, size in chain) > max(LEAST, SHARE * first.whole):
            self._write_whole(self._table(line, commit), commit)
        return commit

    def restore(self, ref: int | str) -> Commit:
        """A new version equal to an old one; nothing is lost, and no row is written."""

        def made(commits: list[Commit], number: int) -> Commit:
            old = self._find(commits, ref).number
            return Commit(number, f"restore {old}", "replay", self._attempt(number), restored=old)

        return self._next(made)

    def tag(self, ref: int | str, name: str) -> Commit:
        commit = self._find(self.log(), ref)
        self._publish("marks", uuid.uuid4().hex, {"number": commit.number, "tag": name})
        commit.tag = name
        return commit

    def clean(self, hours: float = 24.0) -> list[int]:
        """Deletes the whole tables of all but the newest such version that runs can give again, and folders of attempts
        older than ``hours`` that no note names; the numbers of the versions."""
        commits = self.log()
        found = [c for c in commits if c.whole is not None and c.undo == "delta"][:-1]
        for c in found:
            self._publish("marks", uuid.uuid4().hex, {"number": c.number, "whole": None})
            delete(self.spark, f"{self.path}/table/{c.attempt}")
        named, before = {c.attempt for c in commits}, (time.time() - hours * 3600) * 1000
        system = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for folder in ("table", "delta", "unfinished"):
            held = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            for status in system.listStatus(held) if system.exists(held) else []:
                if status.getPath().getName() not in named and status.getModificationTime() < before:
                    system.delete(status.getPath(), True)
        return [c.number for c in found]

    # --- reading

    def checkout(self, ref: int | str | None = None) -> DataFrame:
        """A version as a DataFrame: a whole table, and the runs since."""
        commits = self.log()
        return self._table(commits, self._find(commits, ref))

    def edits(self, ref: int | str) -> DataFrame:
        """seq, edit (as JSON): what a commit was asked to do."""
        commit = self._find(self.log(), ref)
        if not commit.edits:
            return self.spark.createDataFrame([], "seq int, edit string")
        return self.spark.read.schema("seq int, edit string").parquet(f"{self.path}/delta/{commit.attempt}/edits")

    def changes(self, a: int | str, b: int | str) -> DataFrame | None:
        """row_id, old, new of each row number whose row differs between two versions, null where a version lacks it.

        Composed from runs, without the tables. None if a snapshot lies between the versions.
        """
        commits = self.log()
        return self._changes(commits, self._find(commits, a), self._find(commits, b))

    def _changes(self, commits: list[Commit], a: Commit, b: Commit) -> DataFrame | None:
        a, b = self._held(commits, a), self._held(commits, b)
        met = self._meet(commits, a, b)
        if met is None:
            return None
        steps = [(p, False) for p in met[0]] + [(p, True) for p in reversed(met[1])]
        if steps:
            return self._composed(steps)
        held = self._table(commits, a)
        row = F.struct(*[quoted(c) for c in held.columns])
        return held.limit(0).select(quoted(self.row_id), row.alias("old"), row.alias("new"))

    def row_diff(self, a: int | str, b: int | str, exact: bool = False) -> DataFrame:
        """Rows of one version that the other lacks, with ``side``, as ``row_diff`` of the two tables, but from runs where that can be.

        A row that is gone under its number while an equal one, never changed, stays under another counts as removed
        (or added) then; ``exact`` looks such rows up in the tables.
        """
        commits = self.log()
        return self._row_diff(commits, self._find(commits, a), self._find(commits, b), exact)

    def _row_diff(self, commits: list[Commit], a: Commit, b: Commit, exact: bool = False) -> DataFrame:
        found = self._changes(commits, a, b)
        if found is None:
            return row_diff(self._table(commits, a), self._table(commits, b), self.row_id)
        # The rows of both sides from one reading of the changes.
        sides = F.array(*[F.struct(F.col(x).alias("row"), F.lit(x == "old").alias("was")) for x in ("old", "new")])
        rows = found.select(F.explode(sides).alias("side")).where("side.row IS NOT NULL")
        names = [f.name for f in found.schema["old"].dataType if f.name != self.row_id]
        was = unused("__was", names)
        out = _one_sided(rows.select(*[F.col("side.row")[c].alias(c) for c in names], F.col("side.was").alias(was)), was)
        if not exact:
            return out
        names = [c for c in out.columns if c != "side"]
        parts, own = [], unused("__", names)
        for side, other in (("removed", b), ("added", a)):
            # The changed rows of one side that the other table has, too.
            held = self._table(commits, other).select(*[quoted(c).alias(f"{own}{k}") for k, c in enumerate(names)])
            same = F.struct(*[quoted(c) for c in names]).eqNullSafe(F.struct(*[F.col(f"{own}{k}").alias(c) for k, c in enumerate(names)]))
            parts.append(out.where(F.col("side") == side).join(held, same, "left_anti"))
        return parts[0].unionByName(parts[1])

    def diff(self, a: int | str, b: int | str, samples: int = 5) -> dict:
        """Schema changes, row counts of either side, a few rows of each, and the commits after ``a`` up to ``b``."""
        commits = self.log()
        x, y = self._find(commits, a), self._find(commits, b)
        between = {"commits": [c.message for c in commits if x.number < c.number <= y.number]}
        found = self._changes(commits, x, y)
        if found is None:
            return diff(self._table(commits, x), self._table(commits, y), self.row_id, samples) | between
        rows = self._row_diff(commits, x, y)
        counts = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
        shown = {side: [r.asDict() for r in rows.where(F.col("side") == side).drop("side").limit(samples).collect()] for side in ("removed", "added")}
        delta = found.agg(F.count("new") - F.count("old")).first()[0]
        return {"schema": {"added": [], "removed": [], "retyped": []}, "row_delta": delta, "removed": counts.get("removed", 0), "added": counts.get("added", 0), "samples": shown} | between


def parent_positions(child: DataFrame, deleted: list[int] | DataFrame, position: str = "position") -> DataFrame:
    """Adds parent_position: where each row stood before the rows at ``deleted`` were deleted.

    A list of few positions goes into the expression. A table of any size (column ``position``) is
    merged with the child: the k-th deleted position less k is a gap, and a row's place among rows and
    gaps, gaps first, is its old position.
    """
    if isinstance(deleted, DataFrame):
        gaps = number_rows(deleted.select(F.col(deleted.columns[0]).cast("long").alias("__d")), ["__d"], "__k").select((F.col("__d") - F.col("__k")).alias("__at"))
        merged = gaps.select("__at", F.lit(0).alias("__row")).unionByName(child.select(quoted(position).cast("long").alias("__at"), F.lit(1).alias("__row")))
        placed = number_rows(merged, ["__at", "__row"], "parent_position").where("__row = 1")
        return child.join(placed.select(F.col("__at").alias(position), "parent_position"), position).select(*[quoted(c) for c in child.columns], "parent_position")
    gaps = F.array(*[F.lit(d - k).cast("long") for k, d in enumerate(sorted(deleted))]) if deleted else F.array().cast("array<bigint>")
    return child.withColumn("parent_position", quoted(position) + F.size(F.filter(gaps, lambda g: g <= quoted(position))))
