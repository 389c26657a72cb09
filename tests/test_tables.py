import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsheet.operators import columns, combine, edits, enrich, profile, reshape, rows, search, versions
from loomsheet.plans import pipeline, registry
from loomsheet.sources import load, rowid, sinks


def data(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def six(spark):
    rows_ = [("Ann", 30, ("Rome",)), ("bob", 25, ("Oslo",)), (None, 40, None), ("Cid", 25, ("Rome",)), ("Dee", None, ("Bonn",)), ("eva", 31, ("Oslo",))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "row_id long, name string, age long, info struct<city:string>")


# --- row numbers
@pytest.mark.parametrize("parts", [1, 8])
def test_numbers_follow_an_order(spark, parts):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 10).alias("g")).repartition(parts)
    assert [r["k"] for r in rowid.number_rows(df, ["k"]).orderBy("row_id").collect()] == list(range(5000))
    down = rowid.number_rows(df, ["g", "k"], descending=True).orderBy("row_id").collect()
    assert [(r["g"], r["k"]) for r in down] == sorted(((r["g"], r["k"]) for r in down), reverse=True) and [r["row_id"] for r in down] == list(range(5000))


def test_numbers_with_more_ranges_than_a_step(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"))
        assert [r["k"] for r in rowid.number_rows(df, ["k"]).orderBy("row_id").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_numbers_with_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None,), (2,), (1,), (1,), (None,)], "k long")
    assert [r["k"] for r in rowid.number_rows(df, ["k"]).orderBy("row_id").collect()] == [1, 1, 2, None, None]
    assert rowid.number_rows(df.where("false"), ["k"]).count() == 0


def test_file_row_ids(spark, tmp_path):
    for k in range(4):
        spark.range(k * 1000, (k + 1) * 1000, 1, 1).coalesce(1).write.mode("append").parquet(str(tmp_path / f"p/part={k}"))
        os.makedirs(tmp_path / "c", exist_ok=True)
        (tmp_path / f"c/{k}.csv").write_text("n,text\n" + "".join(f"{k * 1000 + i},row {i} with some text\n" for i in range(1000)))
    got = load.load(spark, str(tmp_path / "p"), "parquet", row_id=True).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == [r["id"] for r in got] == list(range(4000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = load.load(spark, str(tmp_path / "c"), "csv", row_id=True).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_id"] for r in got] == [r["n"] for r in got] == list(range(4000))


# --- formats
@pytest.mark.parametrize("fmt", ["parquet", "csv", "tsv", "json", "jsonl", "orc"])
def test_round_trips(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a,b\tc", 1), ("é \"q\"", 2)], "text string, n long")
    path = str(tmp_path / "out")
    sinks.write(df, path, fmt, "gzip" if fmt in ("csv", "tsv", "json", "jsonl") else None)
    assert data(load.load(spark, path, fmt).select("text", "n"), "n") == [("a,b\tc", 1), ("é \"q\"", 2)]


@pytest.mark.parametrize(("text", "n"), [('[{"a": 1}, {"a": 2}]', 2), ('{"a": 1}\n{"a": 2}\n{"a": 3}', 3), ('\n{\n "a": 1\n}', 1), ('{"a": 5}', 1)])
def test_json_kinds(spark, tmp_path, text, n):
    (tmp_path / "x.json").write_text(text)
    assert load.load(spark, str(tmp_path / "x.json")).count() == n


def test_arrow_files(spark, tmp_path):
    table = pa.table({"n": list(range(100)), "t": [f"x{i}" for i in range(100)]})
    for k in range(2):
        with pa.OSFile(str(tmp_path / f"{k}.feather"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table, max_chunksize=30)
    df = load.load(spark, str(tmp_path), "arrow")
    assert df.count() == 200 and df.agg(F.sum("n")).first()[0] == 9900
    assert load.format_of("a/b.JSONL.GZ") == "jsonl" and load.format_of("x.feather") == "arrow"
    with pytest.raises(ValueError):
        load.format_of("x.doc")


def test_exports(spark, six, tmp_path):
    done = sinks.export(six, str(tmp_path / "e"), "parquet", ["name", "age"], [{"column": "age", "operator": "gt", "value": 25}], partition_by=["age"])
    assert done["rows"] == 3 and done["columns"] == 2 and sorted(os.listdir(tmp_path / "e"))[-3:] == ["age=30", "age=31", "age=40"]
    with pytest.raises(ValueError):
        sinks.save_as(six, str(tmp_path / "c"), "csv")
    sinks.save_as(six, str(tmp_path / "s"))
    with pytest.raises(Exception, match="exists"):
        sinks.save_as(six, str(tmp_path / "s"))
    parts = combine.separate(six.withColumn("k", F.when(F.col("age") > 25, "a/b")), "k", str(tmp_path / "parts"))
    assert data(parts.select("value", "part", "rows"), "part") == [("a/b", "a_b", 3), (None, "null", 3)]
    assert sorted(x for x in os.listdir(tmp_path / "parts") if x.startswith("part")) == ["part=a_b", "part=null"]


# --- grouping
def test_aggregates_with_nulls_and_nan(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", float("nan")), (2, "a", 2.0), (3, "b", None), (4, None, 1.0)], "row_id long, g string, v double")
    got = lambda agg: {r["g"]: r["x"] for r in reshape.group_aggregate(df, ["g"], agg, "v", "x").collect()}
    assert got("count") == {"a": 3, "b": 1, None: 1} and got("sum")["b"] == 0 and got("min")["a"] == got("max")["a"] == 2.0
    assert got("n_unique") == {"a": 3, "b": 1, None: 1} and got("first")["a"] is None and got("list")["b"] == [None]
    assert reshape.group_aggregate(df, ["g"], "list", "v", "x").where("g = 'a'").first()["x"][2] == 2.0


def test_dedupe_keeps_the_first(six):
    assert data(rows.dedupe(six.repartition(4), ["age"]).select("row_id"), "row_id") == [(0,), (1,), (2,), (4,), (5,)]
    assert rows.sample_rows(six, 4).count() == 4 and data(rows.sample_rows(six, 4)) == data(rows.sample_rows(six.repartition(3), 4)) and rows.sample_rows(six, 99).count() == 6
    assert [r["age"] for r in rows.sort_rows(six, ["age"], True).collect()] == [40, 31, 30, 25, 25, None]


# --- combining
def test_concat_widens(spark):
    a = spark.createDataFrame([(1, "x", 1)], "n int, t string, z int")
    b = spark.createDataFrame([(1.5, 7)], "n double, t long")
    out = combine.concat([a, b])
    assert out.columns == ["n", "t", "z"] and data(out, "n") == [(1.0, "x", 1), (1.5, "7", None)]


def test_join_names_and_nulls(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    b = spark.createDataFrame([(1, "A"), (None, "B"), (3, "C")], "k long, v string")
    assert data(combine.join(a, b, ["k"]), "k") == [(1, "a", "A")]
    assert data(combine.join(a, b, ["k"], how="right"), "k") == [(None, None, "B"), (1, "a", "A"), (3, None, "C")]
    assert combine.join(a, b, ["k"], how="outer").columns == ["k", "v", "k_right", "v_right"]
    assert combine.merge([a, b, b], ["k"]).columns == ["k", "v", "v_right", "v_right_right"]


# --- pipelines
def test_pipeline_errors_name_the_step(six):
    with pytest.raises(ValueError, match=r"Step 2 \(filter_rows\).*nope"):
        pipeline.run_pipeline(six, [{"op": "limit_rows", "params": {"n": 3}}, {"op": "filter_rows", "params": {"column": "nope", "operator": "eq", "value": 1}}])
    for step in ({"op": "what"}, {"op": "top_n", "params": {}}, {"op": "top_n", "params": {"column": "age", "often": 1}}):
        with pytest.raises(ValueError, match="Step 1"):
            pipeline.run_pipeline(six, [step])


def test_own_functions_and_preview(six):
    registry.register("only", lambda df, column, value: df.where(F.col(column) == value))
    steps = [{"op": "only", "params": {"column": "age", "value": 25}}, {"op": "select_columns", "params": {"columns": "name"}}]
    assert data(pipeline.run_pipeline(six, steps), "name") == [("Cid",), ("bob",)]
    assert pipeline.preview(six, steps, ["row_id"])["total"] == 2
    assert len([s for s in registry.FUNCTIONS.values() if s.category != "own"]) == 32
    with pytest.raises(ValueError):
        registry.register("top_n", lambda df: df)


def test_streams(spark, six, tmp_path):
    six.drop("info").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, name string, age long").parquet(str(tmp_path / "in"))
    out = pipeline.run_pipeline(stream, [{"op": "filter_rows", "params": {"column": "age", "operator": "gt", "value": 25}}, {"op": "transform_text", "params": {"column": "name", "operation": "uppercase"}}])
    q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 3
    with pytest.raises(ValueError, match="stream"):
        pipeline.run_pipeline(stream, [{"op": "sort_rows", "params": {"columns": ["age"]}}])


# --- edits and versions
def test_edits_in_order(six):
    ops = [
        {"op": "update", "row_id": 0, "values": {"age": "33"}}, {"op": "delete", "row_id": 1}, {"op": "update", "row_id": 1, "values": {"age": 1}}, {"op": "update", "row_id": 2, "values": {"name": None, "age": None}},
        {"op": "replace", "column": "name", "find": "ann", "replace": "Anna$1", "mode": "contains", "ignore_case": True}, {"op": "add", "row": {"name": "Zed"}}, {"op": "replace", "column": "age", "find": "25", "replace": 26},
    ]
    out = {r["row_id"]: (r["name"], r["age"]) for r in edits.apply_changes(six, ops).collect()}
    assert out == {0: ("Anna$1", 33), 2: (None, None), 3: ("Cid", 26), 4: ("Dee", None), 5: ("eva", 31), 2**40: ("Zed", None)}
    with pytest.raises(ValueError):
        edits.apply_changes(six, [{"op": "update", "row_id": 0, "values": {"age": "old"}}])
    assert edits.count_matches(six, "name", "E", "contains", True).first()[0] == 2


def test_transform_numbers_anew(six):
    out = edits.transform_rows(six, [{"op": "sort_rows", "params": {"columns": ["age"], "descending": True}}, {"op": "filter_range", "params": {"column": "age", "min": 25}}])
    assert [(r["row_id"], r["name"]) for r in out.orderBy("row_id").collect()] == [(0, None), (1, "eva"), (2, "Ann"), (3, "bob"), (4, "Cid")]


def test_every_version_can_be_had_back(spark, six, tmp_path):
    table = versions.Versions(spark, str(tmp_path / "v"))
    assert table.log() == []
    table.init(six)
    want = [data(six, "row_id")]
    steps = [
        [{"op": "update", "row_id": 0, "values": {"age": None, "name": "A"}}], [{"op": "delete", "row_id": 5}, {"op": "add", "row": {"name": "new", "age": 1}}], [{"op": "replace", "column": "name", "find": "bob", "replace": "rob"}],
        [{"op": "transform", "steps": [{"op": "sort_rows", "params": {"columns": ["name"]}}]}], [{"op": "delete", "row_id": 0}],
    ]
    for ops in steps:
        table.commit(ops, "edit")
        want.append(data(table.checkout(), "row_id"))
    for k, rows_ in enumerate(want):
        assert data(table.checkout(k).select(six.columns), "row_id") == rows_, k
    table.tag(1, "good")
    table.restore("good")
    assert data(table.checkout().select(six.columns), "row_id") == want[1] and table.checkout("good").count() == 6
    assert [c.undo for c in table.log()] == ["none", "delta", "delta", "delta", "snapshot", "delta", "replay"]
    found = table.diff(0, 1)
    assert (found["removed"], found["added"], found["row_delta"]) == (1, 1, 0) and found["commits"] == ["edit"]


def test_diff_tells_nulls_apart(spark):
    a = spark.createDataFrame([(None, 1), (2, 2), (2, 2)], "x long, y long")
    b = spark.createDataFrame([(1, None), (2, 2)], "x long, y long")
    assert sorted(data(versions.row_diff(a, b, None)), key=str) == [(1, None, "added"), (None, 1, "removed")]
    assert versions.schema_changes(a, b.withColumn("z", F.lit(1)).withColumn("y", F.lit("t"))) == {"added": ["z"], "removed": [], "retyped": [("y", "bigint", "string")]}


# --- profiles
def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(float("nan"), None, [1, 2]), (1.0, None, []), (None, None, None), (3.0, None, [2])], "f double, n string, l array<long>")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert (got["f"]["nulls"], got["f"]["min"], got["f"]["max"], got["f"]["mean"], got["f"]["q1"], got["f"]["q3"]) == (1, 1.0, 3.0, 2.0, 1.0, 3.0)
    assert got["n"]["unique"] == 0 and got["l"]["unique"] == 3
    assert data(profile.distribution(df, "l", 2).select("bin", "count"), "bin") == [(1, 1), (2, 2)]
    assert profile.distribution(df, "n").count() == 0 and profile.profile(df.where("false")).count() == 3


@pytest.mark.parametrize("values", [[5], [5, 5, 5], list(range(100)), [-3.5, -3.5, 0.0, 1e-9, 1e12, 7, 7.25], [1, 2, 3, 4]])
def test_nearest_ranks(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    s = sorted(values)
    want = tuple(float(s[int((len(s) - 1) * q + 0.5)]) for q in (0.25, 0.5, 0.75))
    assert tuple(profile.quantile(df, "v").first())[1:] == want


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 0.25, 0.5, 0.75, 1.0, None]], "v double")
    assert [r["count"] for r in profile.histogram(df, "v", 4).orderBy("bin").collect()] == [2, 1, 1, 1]
    assert [r["count"] for r in profile.histogram(df.where("v = 1"), "v", 3).orderBy("bin").collect()] == [1, 0, 0]
    assert profile.histogram(df.where("v IS NULL"), "v", 3).count() == 0


def test_outliers_and_correlations(spark):
    df = spark.createDataFrame([(float(i), float(-i), "t") for i in range(20)] + [(500.0, 1.0, "t")], "a double, b double, t string")
    report = profile.outlier_report(df, "a")
    assert report["values"] == [500.0] and report["count"] == 1 and report["bounds"] == (-10.0, 30.0)
    assert profile.outlier_report(df, "t")["count"] == 0 and profile.outlier_report(df.where("a = 3"), "a", "zscore")["count"] == 0
    with pytest.raises(ValueError):
        profile.outliers(df, "a", "guess").count()
    assert profile.correlations(df.where("a < 100")).where("a = 'a' AND b = 'b'").first()["r"] == pytest.approx(-1)


def test_roles_and_missing(spark):
    df = spark.createDataFrame([(i, "x", None if i % 2 else 1, None if i % 4 else 1) for i in range(200)], "i long, c string, p long, q long")
    assert {r["column"]: r["role"] for r in profile.column_roles(profile.profile(df)).collect()} == {"i": "Identifier-like", "c": "Constant", "p": "Constant", "q": "Constant"}
    assert {(r["a"], r["b"]): r["rows"] for r in profile.missing_pairs(df).collect()} == {("p", "p"): 100, ("q", "q"): 150, ("p", "q"): 100, ("q", "p"): 100}


# --- search
@pytest.fixture(scope="module")
def mixed(spark):
    words = ["Red", "needle-case", "stock", "Überraschung"]
    return spark.createDataFrame([(i, words[i % 4] + f" {i}", i / 2, [i, i + 1], {"k": f"v{i}"}) for i in range(100)], "row_id long, text string, score double, tags array<long>, m map<string,string>")


@pytest.mark.parametrize("query", ["RED", "needle-", "eedl", "0.5", "37", "red 4", "über", "absent", "--", "v12 needle", "true"])
def test_index_search_equals_scan(mixed, query):
    names = [c for c in mixed.columns if c != "row_id"]
    scan = data(search.search(mixed, query, names).select("row_id"), "row_id")
    index = search.index_rows(mixed, 10)
    assert data(search.search_indexed(mixed, index, query, block_rows=10).select("row_id"), "row_id") == scan


def test_blocks_and_pages(spark, mixed, tmp_path):
    search.build_index(mixed, str(tmp_path / "ix"), 10)
    assert search.search_index(spark, str(tmp_path / "ix"), "case 41").count() == 1
    assert data(search.candidate_blocks(search.index_rows(mixed, 10), "überraschung 39"), "block") == [(3,), (7,)]  # 39 is a score there
    assert [r["row_id"] for r in search.search_page(mixed, "red", ["row_id"], ["text"], 2, 3).collect()] == [8, 12, 16]
    assert search.highlights(mixed.limit(1), "red").first()["highlights"] == {"text": "Red 0"}
    with pytest.raises(ValueError):
        search.search(mixed, "  ")


def test_scores(spark):
    df = spark.createDataFrame([(18, "aaa AA"), (65, None), (None, "")], "age long, t string")
    out = enrich.bucketize(enrich.keyword_score(enrich.keyword_tag(df, "t", "tag", {"x": ["A"]}), "t", "s", {"aa": 2}), "age", [18, 65], "b")
    assert [tuple(r)[2:] for r in out.collect()] == [("x", 4.0, "(-inf, 18]"), ("other", 0.0, "(18, 65]"), ("other", 0.0, None)]


def test_sort_and_merge_take_all_rows(spark, sf):
    from loomsheet.queries import QUERIES

    many = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").count()
    assert QUERIES["o52_sort_rows_all"](spark, sf).count() == many("part") > 100
    assert QUERIES["o43_merge_all"](spark, sf).where("n_chars IS NOT NULL").count() == many("documents")


def test_many_deletions(spark):
    gone = [0, 1, 5, 6, 7, 20, 99]
    left = [k for k in range(100) if k not in gone]
    child = spark.createDataFrame(list(enumerate(left)), "position long, was long")
    rows_ = versions.parent_positions(child, spark.createDataFrame([(k,) for k in gone], "position long")).collect()
    assert len(rows_) == len(left) and all(r["parent_position"] == r["was"] for r in rows_)


def test_edits_are_described(spark, six):
    ops = [{"op": "update", "row_id": 1, "values": {"name": "x"}}, {"op": "delete", "row_id": 2}, {"op": "replace", "column": "name", "find": "a", "replace": "b"}, {"op": "add", "row": {"name": "y"}}]
    held = edits.change_table(six, ops)
    assert [r["label"] for r in held.orderBy("seq").collect()] == ["Row 1: set name to x", "Row 2: deleted", "name: replaced a by b", "Added 1 row(s)"]
    assert {r["op"]: r["changes"] for r in edits.change_summary(held).collect()} == {"update": 1, "delete": 1, "replace": 1, "add": 1}


def test_presets_match_whole_phrases(spark):
    from loomsheet.operators import text

    said = "a@b.com. call 555 1234 on 12/31/2024 or 2024-01-02, pay 1,5 see http://x.org/a) #tag @me"
    df = spark.createDataFrame([(said,)], "t string")
    found = {p: text.extract_pattern(df, "t", "f", p).first()["f"] for p in ("email", "phone", "date", "number", "url", "hashtag", "mention")}
    assert found["email"] == ["a@b.com"] and found["phone"] == ["555 1234", "2024-01-02"] and found["date"] == ["12/31/2024", "2024-01-02"]
    assert "1,5" in found["number"] and found["url"] == ["http://x.org/a"] and found["hashtag"] == ["#tag"] and found["mention"] == ["@b", "@me"]


def test_medians_of_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", 2.0), ("a", 9.0), ("a", float("nan")), ("b", None), ("c", -5.0)], "g string, x double")
    assert {r["g"]: r["x_median"] for r in reshape.group_aggregate(df, ["g"], "median", "x").collect()} == {None: 2.5, "a": 5.5, "b": None, "c": -5.0}
    assert [r["x"] for r in columns.fill_missing(df.where("x IS NULL OR x < 5"), "x", "median").where("g = 'b'").collect()] == [1.5]


def test_an_index_reads_only_its_ranges(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id").isin(37, 2981), "rare needle").otherwise("hay").alias("t"))
    search.build_index(df, str(tmp_path / "i"), 10)
    found = search.search_index(spark, str(tmp_path / "i"), "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r["row_id"] for r in found.orderBy("row_id").collect()] == [37, 2981] and "PushedFilters: [Or(And(GreaterThanOrEqual(row_id,30)" in plan
    assert search.search_index(spark, str(tmp_path / "i"), "nothing").count() == 0 and search.search_index(spark, str(tmp_path / "i"), "ha").count() == 2998


def test_every_function_tells_what_it_takes_and_gives():
    for name, spec in registry.FUNCTIONS.items():
        if spec.category != "own":
            assert spec.text and spec.output != "a table" and spec.example["op"] == name and "..." not in spec.example["params"].values()


def test_examples_run(spark):
    df = spark.createDataFrame([(0, "A b", "en", 3), (1, None, "de", 0)], "row_id long, text string, lang string, n_chars long")
    for name in ("filter_rows", "filter_keywords", "sort_rows", "select_columns", "rename_columns", "cast_column", "text_metric", "transform_text", "group_aggregate", "keyword_tag", "keyword_score", "weighted_score", "bucketize", "replace_values", "fill_missing", "value_counts"):
        pipeline.run_pipeline(df, [registry.FUNCTIONS[name].example]).collect()


def test_a_hot_value_fills_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_A_FILE", 100)
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit(None).cast("string").alias("n"))
    made = sinks.export(df, str(tmp_path / "p"), partition_by=["k"])
    assert made["bytes"] > 0 and made["rows"] == 1000
    assert len(list((tmp_path / "p" / "k=hot").glob("*.parquet"))) >= 5 and spark.read.parquet(str(tmp_path / "p")).count() == 1000


@pytest.mark.parametrize("most", [100, 150])
def test_a_value_has_no_more_files_than_its_rows_fill(spark, tmp_path, monkeypatch, most):
    """Also where its rows fill its files to the last row, and where its tasks take several."""
    monkeypatch.setattr(sinks, "ROWS_A_FILE", most)
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").when(F.col("id") < 960, "cold").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.export(df, str(tmp_path / "p"), partition_by=["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "p")).select("id", "k", F.input_file_name().alias("file"))
    back = back.groupBy("k").agg(F.count_distinct("file"), F.count_distinct("id"), F.count("*"))
    assert {r[0]: tuple(r)[1:] for r in back.collect()} == {"hot": (900 // most, 900, 900), "cold": (1, 60, 60), None: (1, 40, 40)}


def test_equal_keys_are_numbered_densely(spark):
    df = spark.range(20_000).select("id", F.lit(7).alias("k"), F.lit("x").alias("row_id"))
    out = rowid.number_rows(df.repartition(8), ["k"], "n")
    assert out.columns == ["n", "id", "k", "row_id"] and out.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (20_000, 0, 19_999)
    again = {r["id"]: r["n"] for r in rowid.number_rows(df.repartition(3), ["k"], "n").collect()}
    assert {r["id"]: r["n"] for r in out.collect()} == again
