"""Equal rows, hot values and large files spread over tasks; streams of repeated and late events."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsheet import queries
from loomsheet.operators import combine
from loomsheet.sources import arrow_files, rowid
from loomsheet.sources.load import load
from loomsheet.streaming import state


def test_equal_rows_spread_over_ranges(spark, tmp_path):
    spark.range(0, 400_000, 1, 20).select(F.lit("same").alias("x"), F.lit(1).alias("y")).write.parquet(str(tmp_path / "t"))
    same = spark.read.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        ranges, _ = rowid._in_ranges(same, ["x"], False)
        most = ranges.groupBy("__bucket").count().agg(F.max("count"), F.count("*")).first()
        assert most[0] <= 80_000 and most[1] >= 5
        numbered = rowid.number_rows(same, ["x"])
        found = numbered.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()
        assert tuple(found) == (400_000, 400_000, 0, 399_999) and numbered.columns == ["row_id", "x", "y"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_of_joined_tables(spark):
    a, b = spark.range(30).withColumn("g", F.col("id") % 3), spark.range(3).toDF("g")
    assert sorted(r["row_id"] for r in rowid.number_rows(a.join(b, "g"), ["g"]).collect()) == list(range(30))


def test_separated_values_have_few_files(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 16).select("id", (F.col("id") % 3).alias("v"), F.lit("mine").alias("part"))
    made = combine.separate(df, "v", str(tmp_path / "s"))
    assert [r["rows"] for r in made.orderBy("value").collect()] == [6667, 6667, 6666]
    folders = [p for p in Path(tmp_path / "s").iterdir() if p.is_dir()]
    assert {p.name for p in folders} == {"_part=0", "_part=1", "_part=2"} and all(len(list(p.glob("*.parquet"))) == 1 for p in folders)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("part = 'mine'").count() == 20_000 and set(made.select("path").first()) <= {f"{tmp_path}/s/_part={k}" for k in range(3)}


def test_one_arrow_file_gives_several_tasks(spark, tmp_path):
    table = pa.table({"n": list(range(10_000)), "t": [f"text {k}" for k in range(10_000)], "x": [None if k % 10 == 0 else k / 7 for k in range(10_000)]})
    with pa.OSFile(str(tmp_path / "big.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as out:
        for batch in table.to_batches(max_chunksize=100):
            out.write_batch(batch)
    df = load(spark, str(tmp_path / "big.arrow"), splitBytes=20_000)
    assert 10 <= df.rdd.getNumPartitions() <= 100 and df.count() == 10_000 and df.agg(F.sum("n")).first()[0] == sum(range(10_000))
    assert load(spark, f"file://{tmp_path}/big.arrow").rdd.getNumPartitions() == 1 and load(spark, f"{tmp_path}/*.arrow").count() == 10_000
    for where, want in (("n >= 9990 AND n < 9995", 5), ("n IN (3, 5, null)", 2), ("t = 'text 77'", 1), ("t LIKE 'text 99%'", 111), ("x IS NULL", 1000), ("x > 1428.0", 3), ("x IS NOT NULL AND n < 10", 9), ("n % 2 = 0 AND n < 100", 50)):
        assert df.where(where).count() == want, where


def test_filters_reach_arrow_files(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

    schema = pa.schema([("n", pa.int64()), ("x", pa.float64())])
    table = pa.table({"n": [1, 2, None], "x": [1.0, None, 3.0]}, schema=schema)
    assert table.filter(arrow_files.condition(EqualTo(("n",), 2), schema)).num_rows == 1 and table.filter(arrow_files.condition(IsNull(("x",)), schema)).num_rows == 1
    assert arrow_files.condition(GreaterThan(("x",), 2.0), schema) is None and arrow_files.condition(EqualTo(("s", "a"), 1), schema) is None


def test_arrow_files_are_committed(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).withColumn("t", F.concat(F.lit("é"), "id"))
    assert arrow_files.write(df, str(tmp_path / "out")) == 1000
    assert len(list((tmp_path / "out").iterdir())) == 4 and not [p for p in (tmp_path / "out").iterdir() if p.name[0] == "."]
    assert load(spark, str(tmp_path / "out"), "arrow").count() == 1000
    assert arrow_files.write(df.limit(0), str(tmp_path / "none")) == 0 and load(spark, str(tmp_path / "none"), "arrow").count() == 0
    with pytest.raises(Exception):
        arrow_files.write(df.select(F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id")), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").glob("*.arrow"))


def stream_of(spark, events, folder, make, name):
    """What a stream of the events, in files of their order of arrival, gives in all."""
    for k, part in enumerate(events):
        part.coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(events[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in/*")
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_repeated_and_late_events(spark, sf, tmp_path):
    """Each event arrives up to three times, out of order; the stream gives what the table gives."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").orderBy("ts").limit(150)
    held = spark.createDataFrame(events.collect(), events.schema)
    again = held.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    again = again.withColumn("ts", F.col("ts") + F.make_dt_interval(mins=F.col("copy") * 7)).withColumn("value", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value") + F.col("copy"))).drop("copy")
    rows = again.orderBy("ts").collect()
    # Neighbours in time arrive in reverse order, in three files; the last file only moves the watermark on.
    third = -(-len(rows) // 3)
    files = [spark.createDataFrame(rows[k : k + third][::-1], again.schema) for k in range(0, len(rows), third)]
    span = (rows[-1]["ts"] - rows[0]["ts"]).total_seconds()
    late = f"{int(span) + 3600} seconds"
    far = lambda k: spark.sql(f"SELECT -{k}L AS event_id, timestamp '2100-01-0{k}' AS ts, 'end' AS event_type, 0.0D AS value")
    found = stream_of(spark, [*files, far(1), far(2)], tmp_path / "first", lambda s: state.first_of_key(s, "event_id", "ts", late), "firsts").where("event_id >= 0")
    want = state.first_of_key(again, "event_id", "ts")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() == 150
    found = stream_of(spark, files, tmp_path / "dedupe", lambda s: state.dedupe(s, ["event_id"], "ts", late), "deduped")
    assert sorted(r["event_id"] for r in found.collect()) == sorted(r["event_id"] for r in state.dedupe(again, ["event_id"], "ts").collect())


def test_first_of_key_on_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "2024-01-01 00:00:00", "b"), (2, "2024-01-02 00:00:00", None), (2, "2024-01-02 00:00:00", "c"), (2, "2024-01-03 00:00:00", "a")], "key long, t string, x string").withColumn("t", F.to_timestamp("t"))
    assert [(r["key"], r["x"]) for r in state.first_of_key(df, "key", "t").collect()] == [(2, None)] and state.first_of_key(df.limit(0), "key", "t").count() == 0


def test_ranges_are_found_without_a_list_for_each_row_and_numbered_by_many_tasks(spark, tmp_path, monkeypatch):
    """Compiled comparisons find a row's range; rows of few bytes aren't left to one task."""
    monkeypatch.setattr(rowid, "ROWS_A_TASK", 1_000)
    spark.range(0, 40_000, 1, 4).select(F.lit("same").alias("x")).write.parquet(str(tmp_path / "t"))
    numbered = rowid.number_rows(spark.read.parquet(str(tmp_path / "t")), ["x"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "lambda" not in plan
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(__bucket" in plan
    assert numbered.agg(F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (40_000, 0, 39_999)


def test_split_files_are_written_by_the_tasks_of_the_scan(spark, sf, tmp_path, monkeypatch):
    spark.read.parquet(f"{sf}/lineitem.parquet").repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(queries, "scratch", lambda *_: str(tmp_path / "arrow"))
    found = queries.QUERIES["o10_split_file"](spark, str(tmp_path))
    rows = [pa.ipc.open_file(str(p)).num_record_batches and pa.ipc.open_file(str(p)).read_all().num_rows for p in (tmp_path / "arrow").glob("*.arrow")]
    assert len(rows) >= 3 and max(rows) < sum(rows) / 2
    assert found.count() == spark.read.parquet(f"{sf}/lineitem.parquet").where("l_returnflag = 'R' AND l_orderkey >= 100").count()
