"""Versions: what commits write, what survives, and differences from deltas alone."""

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from loomsheet.operators import versions
from loomsheet.operators.versions import FAN, Versions
from loomsheet.sources import buckets
from loomsheet.sources.shared import bytes_under


def data(df, by="row_id"):
    return [tuple(r) for r in df.orderBy(by).collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    held = Versions(spark, str(tmp_path / "v"))
    held.init(spark.range(40).select(F.col("id").alias("row_id"), F.concat(F.lit("value "), "id").alias("x"), (F.col("id") % 5).alias("y")))
    return held


def test_many_small_commits_write_little(spark, tmp_path):
    """64 one-row commits: kilobytes for each, chains of few runs, all versions as they were, also after clean."""
    sizes = []
    for n in (1_000, 200_000):
        table = Versions(spark, str(tmp_path / f"v{n}"))
        table.init(spark.range(n).select(F.col("id").alias("row_id"), F.concat(F.lit("value "), "id").alias("x")))
        for k in range(64 if n == 1_000 else 9):
            table.commit([{"op": "update", "row_id": k, "values": {"x": "new"}}, {"op": "add", "row": {"x": f"added {k}"}}])
        sizes.append(bytes_under(spark, str(tmp_path / f"v{n}" / "delta")) / (k + 1))
        if n == 1_000:
            commits = table.log()
            assert all(len(table._chain(commits, c)[1]) <= 2 * (FAN - 1) for c in commits) and len(table._chain(commits, commits[64])[1]) == 1
            assert sum(c.whole is not None for c in commits) == 1
            assert table.clean() == []
        for v in (0, 1, 8, 9) if n > 1_000 else (0, 7, 8, 63, 64):
            held = table.checkout(v)
            assert held.count() == n + v and held.where("x = 'new'").count() == v and held.select("row_id").distinct().count() == n + v
    assert max(sizes) < 40_000 and abs(sizes[0] - sizes[1]) < 4_000  # part files and footers


def test_whole_tables_are_written_when_runs_grow(spark, table, monkeypatch):
    monkeypatch.setattr(versions, "LEAST", 0)
    monkeypatch.setattr(versions, "SHARE", 3.0)
    want = [data(table.checkout())]
    for k in range(7):
        table.commit([{"op": "replace", "column": "x", "find": "value", "replace": f"value {k}", "mode": "contains"}])
        want.append(data(table.checkout()))
    whole = [c.number for c in table.log() if c.whole is not None and c.undo == "delta"]
    assert len(whole) >= 2 and table.clean() == whole[:-1]
    assert [data(table.checkout(k)) for k in range(8)] == want
    assert all(len(table._chain(table.log(), c)[1]) <= 2 * (FAN - 1) for c in table.log())


def test_a_commit_that_died_does_not_matter(spark, table, monkeypatch):
    """Killed after its rows were written: the next commit works, nothing of the dead one shows, and clean removes it."""
    table.commit([{"op": "delete", "row_id": 1}])
    real = Versions._publish

    def killed(self, folder, name, record):
        raise KeyboardInterrupt

    monkeypatch.setattr(Versions, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        table.commit([{"op": "delete", "row_id": 2}], "dead")
    monkeypatch.setattr(Versions, "_publish", real)
    made = table.commit([{"op": "delete", "row_id": 3}], "alive")
    assert made.number == 2 and [c.message for c in table.log()] == ["first", "", "alive"]
    assert {r[0] for r in data(table.checkout())} == set(range(40)) - {1, 3}
    folders = lambda: len([f for f in spark.sparkContext._jvm.java.io.File(f"{table.path}/delta").list()])
    before = folders()
    assert table.clean() == [] and folders() == before  # it might still be at work
    assert table.clean(hours=-1) == [] and folders() == before - 1 and table.checkout().count() == 38


def test_of_two_writers_one_starts_again(spark, table, monkeypatch):
    """Both commits are there afterwards, in some order, and neither is lost."""
    gate, real = threading.Barrier(2), Versions._publish
    first = threading.local()

    def together(self, folder, name, record):
        if folder == "notes" and not getattr(first, "done", False):
            first.done = True
            gate.wait(60)
        return real(self, folder, name, record)

    monkeypatch.setattr(Versions, "_publish", together)
    made, errors = [], []

    def write(k):
        try:
            made.append(Versions(spark, table.path).commit([{"op": "delete", "row_id": k}, {"op": "add", "row": {"x": f"by {k}"}}], f"writer {k}").number)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (7, 8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(made) == [1, 2] and {c.message for c in table.log()} == {"first", "writer 7", "writer 8"}
    rows = table.checkout().collect()
    assert len(rows) == 40 and not {7, 8} & {r["row_id"] for r in rows} and {"by 7", "by 8"} <= {r["x"] for r in rows}
    with pytest.raises(ValueError):
        table.init(spark.range(1).select(F.col("id").alias("row_id")))


def random_edits(rng, ids):
    ops = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["update", "update", "delete", "add", "replace"])
        k = rng.choice(ids)
        if kind == "update":
            ops.append({"op": "update", "row_id": k, "values": {"x": rng.choice([None, f"r{rng.random()}"])}})
        elif kind == "delete":
            ops.append({"op": "delete", "row_id": k})
        elif kind == "add":
            ops.append({"op": "add", "row": {"x": f"a{rng.random()}", "y": rng.randint(0, 9)}})
        else:
            ops.append({"op": "replace", "column": "x", "find": f"value {k}", "replace": f"v{rng.random()}"})
    return ops


def test_differences_come_from_deltas(spark, table):
    """On a random history with restored versions: equal to a comparison of the tables, either way, without reading them."""
    rng = random.Random(5)
    tables = [data(table.checkout())]
    for k in range(1, 15):
        if k in (6, 11):
            table.restore(rng.randrange(k))
        else:
            table.commit(random_edits(rng, [r[0] for r in tables[-1]]))
        tables.append(data(table.checkout()))
    for a, b in [(0, 14), (14, 0), (3, 3), (8, 13), (0, 9), *[(rng.randrange(15), rng.randrange(15)) for _ in range(2)]]:
        found = table.changes(a, b)
        before, after = ({r[0]: tuple(r) for r in tables[v]} for v in (a, b))
        want = {k: (before.get(k), after.get(k)) for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
        assert {r["row_id"]: (r["old"] and tuple(r["old"]), r["new"] and tuple(r["new"])) for r in found.collect()} == want, (a, b)
        assert "/table/" not in found.inputFiles().__str__()
        one = sorted(map(str, table.row_diff(a, b, exact=True).collect()))
        assert one == sorted(map(str, versions.row_diff(table.checkout(a), table.checkout(b)).select("x", "y", "side").collect())), (a, b)
        assert table.diff(a, b)["row_delta"] == len(after) - len(before)


def test_differences_over_a_snapshot_compare_the_tables(spark, table):
    table.commit([{"op": "transform", "steps": [{"op": "sort_rows", "params": {"columns": ["x"]}}]}])
    table.commit([{"op": "delete", "row_id": 0}])
    assert table.changes(0, 2) is None and table.changes(1, 2).count() == 1
    assert (table.diff(0, 2)["removed"], table.diff(0, 2)["row_delta"]) == (1, -1)


def test_edits_are_kept_apart_from_notes(spark, table):
    ops = [{"op": "update", "row_id": k, "values": {"x": "secret"}} for k in range(3)]
    table.commit(ops, "three")
    notes = "".join(r[0] for r in spark.read.text(f"{table.path}/notes").collect())
    assert "secret" not in notes and [r["seq"] for r in table.edits(1).orderBy("seq").collect()] == [0, 1, 2] and table.edits(0).count() == 0


def test_columns_named_as_helpers_are(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "v"))
    table.init(spark.createDataFrame([(0, 1, 2, 3, 4), (1, 5, 6, 7, 8)], "row_id long, old long, new long, __0 long, __new_0 long"))
    table.commit([{"op": "update", "row_id": 0, "values": {"old": 9}}, {"op": "delete", "row_id": 1}])
    assert data(table.checkout()) == [(0, 9, 2, 3, 4)] and table.diff(0, 1)["removed"] == 2
    parent, child = table.checkout(0), table.checkout(1)
    deleted, cells = versions.build_undo(parent, child)
    assert data(versions.apply_undo(child, deleted, cells)) == data(parent)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Undoing, its deltas and both versions bucketed by the row number: no Exchange anywhere in the plans."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parent = spark.range(5_000).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"), F.lit("t").alias("t"))
        child = parent.where("row_id % 7 <> 0").withColumn("x", F.when(F.col("row_id") % 5 == 0, -1).otherwise(F.col("x")))
        held = {}
        for name, df in (("parent", parent), ("child", child)):
            buckets.write(df, f"file://{tmp_path}/{name}", "row_id", 4)
            held[name] = buckets.read(spark, f"file://{tmp_path}/{name}", "row_id", 4)
        deleted, cells = versions.build_undo(held["parent"], held["child"], ["x"])
        assert "Exchange" not in plan_of(deleted) and "Exchange" not in plan_of(cells)
        for name, df in (("deleted", deleted), ("cells", cells)):
            buckets.write(df, f"file://{tmp_path}/{name}", "row_id", 4)
            held[name] = buckets.read(spark, f"file://{tmp_path}/{name}", "row_id", 4)
        back = versions.apply_undo(held["child"], held["deleted"], held["cells"])
        assert "Exchange" not in plan_of(back) and data(back) == data(parent)
        spark.sql(f"DROP TABLE {buckets._name(f'file://{tmp_path}/parent')}")  # as a new session, which doesn't know it
        again = buckets.read(spark, f"file://{tmp_path}/parent", "row_id", 4)
        assert data(again) == data(parent) and not re.search("Exchange", plan_of(again.join(held["child"], "row_id")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checkout_shuffles_no_table(spark, table):
    for k in range(3):
        table.commit([{"op": "update", "row_id": k, "values": {"x": "new"}}])
    plan = plan_of(table.checkout())
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
    assert "SortMergeJoin" not in plan


def test_a_diff_composes_the_changes_once(spark, table):
    """Both sides were composed, made distinct and joined each way: ten exchanges for two runs, now one to compose and one to compare."""
    table.commit([{"op": "replace", "column": "y", "find": 3, "replace": 4}, {"op": "delete", "row_id": 7}])
    table.commit([{"op": "update", "row_id": 8, "values": {"y": None}}, {"op": "update", "row_id": 9, "values": {"y": 4}}, {"op": "add", "row": {"x": None, "y": 1}}])
    found = table.row_diff(0, 2)
    assert plan_of(found).count("Exchange") == 2
    want = {(x, y, "removed") for x, y in [("value 7", 2), *((f"value {k}", k % 5) for k in (3, 8, 13, 18, 23, 28, 33, 38)), ("value 9", 4)]}
    want |= {(f"value {k}", 4, "added") for k in (3, 13, 18, 23, 28, 33, 38)} | {("value 8", None, "added"), (None, 1, "added")}
    assert {tuple(r) for r in found.collect()} == want - {("value 9", 4, "removed")} and found.count() == len(want) - 1


def test_a_row_diff_has_one_shuffle(spark):
    schema = "row_id long, a double, b string"
    nan = float("nan")
    left = spark.createDataFrame([(1, None, None), (2, nan, "x"), (3, 1.0, "x"), (4, 1.0, "x"), (5, 2.0, None), (6, 0.0, "z")], schema)
    right = spark.createDataFrame([(1, nan, "x"), (2, None, None), (3, 2.0, "y"), (4, 2.0, "y"), (5, -0.0, "z")], schema)
    found = versions.row_diff(left, right)
    assert plan_of(found).count("Exchange") == 1
    assert sorted(tuple(map(str, r)) for r in found.collect()) == [("1.0", "x", "removed"), ("2.0", "None", "removed"), ("2.0", "y", "added")]
    assert sorted(r["side"] for r in versions.row_diff(left, right.limit(0)).collect()) == ["removed"] * 5


def test_large_runs_are_composed_once(spark, table, monkeypatch):
    """Runs too large to broadcast join the table once; before, they were read for the rows that go and for those that come."""
    table.commit([{"op": "replace", "column": "y", "find": 3, "replace": 4}, {"op": "delete", "row_id": 7}, {"op": "add", "row": {"x": "n", "y": None}}])
    table.commit([{"op": "delete", "row_id": 8}, {"op": "update", "row_id": 3, "values": {"y": 3, "x": None}}, {"op": "add", "row": {"x": "m"}}])
    want = [data(table.checkout(v)) for v in (1, 2)]
    assert plan_of(table.checkout(2)).count("FileScan parquet") == 5
    monkeypatch.setattr(versions, "SMALL", 0)
    assert plan_of(table.checkout(2)).count("FileScan parquet") == 3
    assert [data(table.checkout(v)) for v in (1, 2)] == want
