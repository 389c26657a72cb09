"""The registered queries: one or more for each operator of the blueprint, with the SQL that each must agree with.

Every query reads the given tables. Numbers that come from divisions are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import combine, columns, edits, enrich, predicates, profile, reshape, rows, search, text, versions
from .plans.pipeline import PREVIEW, SHOWN, preview, run_pipeline
from .sources import arrow_files, sinks
from .sources.load import load
from .sources.rowid import number_rows, with_file_row_id
from .sources.shared import scratch
from .streaming.guard import windowed_counts
from .streaming.state import dedupe, first_of_key

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, tables: str, sql: str | None = None):
    """Registers fn(*tables); the tables are named in one string."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*[table(spark, sf_dir, t) for t in tables.split()])
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def r6(c):
    return F.round(c, 6)


# --- sources (O-03, O-11) and the whole pipeline (O-58, O-59)
@query("o03_parquet_scan", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def _(orders):
    return orders.select("o_orderkey", "o_totalprice").where("o_totalprice > 200000")


@query("o11_row_id", "orders", "SELECT file_row_number AS row_id, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS file_row_number FROM orders)")
def _(orders):
    return number_rows(orders.select("o_orderkey"), ["o_orderkey"]).select("row_id", "o_orderkey")


@query(
    "o11_equal_rows", "lineitem",
    "SELECT l_returnflag, min(i) AS lowest, max(i) AS highest, count(*) AS different FROM (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS i FROM lineitem) GROUP BY 1",
)
def _(lineitem):
    """Rows of three values only: a value's numbers have no gaps."""
    numbered = number_rows(lineitem.select("l_returnflag"), ["l_returnflag"])
    return numbered.groupBy("l_returnflag").agg(F.min("row_id").alias("lowest"), F.max("row_id").alias("highest"), F.count_distinct("row_id").alias("different"))


def _files_row_id(spark, sf_dir):
    numbered = with_file_row_id(spark.read.parquet(f"{sf_dir}/documents.parquet"), True)
    return numbered.agg(F.count(F.lit(1)).alias("rows"), F.min("row_id").alias("lowest"), F.max("row_id").alias("highest"), F.count_distinct("row_id").alias("different"))


QUERIES["o11_file_row_id"] = _files_row_id
ORACLE_SQL["o11_file_row_id"] = 'SELECT count(*) AS "rows", 0::BIGINT AS lowest, count(*) - 1 AS highest, count(*) AS different FROM documents'

FLAGSHIP = [
    {"op": "filter_rows", "params": {"column": "lang", "operator": "eq", "value": "en"}},
    {"op": "text_metric", "params": {"column": "text", "metric": "word_count", "new_column": "words"}},
    {"op": "extract_pattern", "params": {"column": "text", "new_column": "emails", "pattern": "[a-z0-9.]+@[a-z0-9.]+", "all": True}},
    {"op": "group_aggregate", "params": {"by": ["source"], "agg": "mean", "column": "words", "new_column": "mean_words"}},
    {"op": "sort_rows", "params": {"columns": ["mean_words", "source"], "descending": True}},
]


@query("o59_pipeline", "documents", "SELECT source, round(avg(len(string_split(text, ' '))), 6) AS mean_words FROM documents WHERE lang = 'en' GROUP BY source")
def _(documents):
    return run_pipeline(documents, FLAGSHIP).withColumn("mean_words", r6("mean_words"))


@query(
    "o59_pipeline_cleaning", "orders",
    "SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_totalprice BETWEEN 1000 AND 150000 AND (o_orderstatus = 'O' OR o_orderstatus = 'F') GROUP BY 1",
)
def _(orders):
    return run_pipeline(
        orders,
        [
            {"op": "filter_range", "params": {"column": "o_totalprice", "min": "1000", "max": 150000}},
            {"op": "filter_keywords", "params": {"column": "o_orderstatus", "keywords": ["o", "f"]}},
            {"op": "value_counts", "params": {"column": "o_orderpriority"}},
        ],
    )


# --- formats written and read again (O-02 to O-08, O-13 to O-18, O-45, O-68a)
_PLAIN = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _plain(orders):
    return orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


for _name, (_format, _codec) in {
    "o04_csv": ("csv", None), "o04_tsv": ("tsv", None), "o06_json_lines": ("jsonl", None), "o07_gzipped_json_lines": ("jsonl", "gzip"), "o08_orc": ("orc", None), "o13_parquet_zstd": ("parquet", "zstd"), "o16_gzipped_csv": ("csv", "gzip"),
}.items():

    def _round_trip(orders, name=_name, fmt=_format, codec=_codec):
        path = scratch(orders.sparkSession, name)
        sinks.write(_plain(orders), path, fmt, codec)
        return load(orders.sparkSession, path, fmt).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_totalprice", "o_orderpriority")

    query(_name, "orders", _PLAIN)(_round_trip)


def _json_arrays(customer, codec):
    """A JSON array in each file, one file for each of some ranges of rows."""
    path = scratch(customer.sparkSession, "json")
    lines = customer.select(F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("j"), F.floor(F.col("c_custkey") / 1000).alias("file"))
    marks = customer.select(F.floor(F.col("c_custkey") / 1000).alias("file")).distinct()
    first, last = (marks.select(F.lit(x).alias("value"), "file", F.lit(at).alias("at")) for x, at in (("[{}", 0), ("]", 2)))
    body = lines.select(F.concat(F.lit(","), "j").alias("value"), "file", F.lit(1).alias("at"))
    whole = first.unionByName(body).unionByName(last).repartition(8, "file").sortWithinPartitions("file", "at").drop("at")
    whole.write.partitionBy("file").option("compression", codec or "none").text(path)
    out = load(customer.sparkSession, f"{path}/*", "json")
    return out.where("c_custkey IS NOT NULL").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))


for _name, _codec in {"o05_json_array": None, "o07_gzipped_json_array": "gzip"}.items():
    query(_name, "customer", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")(lambda customer, codec=_codec: _json_arrays(customer, codec))


@query("o14_export", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000")
def _(orders):
    path = scratch(orders.sparkSession, "export")
    sinks.export(orders, path, "parquet", ["o_orderkey", "o_totalprice"], [{"column": "o_totalprice", "operator": "gte", "value": 150000}])
    return load(orders.sparkSession, path, "parquet")


@query("o14_export_measures", "orders", "SELECT count(*) AS \"rows\", 2 AS columns, true AS has_bytes FROM orders WHERE o_totalprice >= 150000")
def _(orders):
    made = sinks.export(orders, scratch(orders.sparkSession, "export"), "parquet", ["o_orderkey", "o_totalprice"], [{"column": "o_totalprice", "operator": "gte", "value": 150000}])
    return orders.sparkSession.createDataFrame([(made["rows"], made["columns"], made["bytes"] > 0)], "rows long, columns int, has_bytes boolean")


@query("o15_partitioned_export", "orders", "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1")
def _(orders):
    path = scratch(orders.sparkSession, "parts")
    sinks.export(orders, path, "parquet", partition_by=["o_orderstatus"])
    return reshape.group_aggregate(load(orders.sparkSession, path, "parquet"), ["o_orderstatus"], "count")


@query("o18_save_as", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(customer):
    path = scratch(customer.sparkSession, "saved")
    sinks.save_as(customer, path, filters=[{"column": "c_mktsegment", "operator": "eq", "value": "BUILDING"}])
    return load(customer.sparkSession, path, "parquet").select("c_custkey", "c_name")


@query("o19_separate_files", "orders", "SELECT o_orderkey, replace(o_orderpriority, '/', '_') AS part FROM orders")
def _(orders):
    path = scratch(orders.sparkSession, "separate")
    combine.separate(orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", path)
    return load(orders.sparkSession, path, "parquet").select("o_orderkey", F.col("part").cast("string").alias("part"))


@query("o45_combine_and_save", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(orders, customer):
    path = scratch(orders.sparkSession, "combined")
    combine.combine_and_save(combine.join(orders.select("o_orderkey", "o_custkey"), customer.select("c_custkey", "c_name"), ["o_custkey"], ["c_custkey"]), path)
    return load(orders.sparkSession, path, "parquet").select("o_orderkey", "c_name")


@query("o19_files", "orders", f"SELECT replace(o_orderpriority, '/', '_') AS part, ceil(count(*) / {sinks.ROWS_A_FILE}.0)::BIGINT AS files, count(*) AS \"rows\" FROM orders GROUP BY 1")
def _(orders):
    """A value has as many files as its rows fill, of ``ROWS_A_FILE`` rows each."""
    path = scratch(orders.sparkSession, "separate")
    combine.separate(orders.repartition(16).select("o_orderkey", "o_orderpriority"), "o_orderpriority", path)
    held = load(orders.sparkSession, path, "parquet").select(F.col("part").cast("string").alias("part"), F.input_file_name().alias("file"))
    return held.groupBy("part").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("rows"))


def _versioned(part) -> versions.Versions:
    held = versions.Versions(part.sparkSession, scratch(part.sparkSession, "versions"))
    held.init(number_rows(part.select("p_partkey", "p_size"), ["p_partkey"]))
    held.commit([{"op": "delete", "row_id": 3}, {"op": "update", "row_id": 5, "values": {"p_size": 99}}], "first edit")
    held.commit([{"op": "replace", "column": "p_size", "find": 10, "replace": 11}], "second edit")
    return held


@query("o68a_commit_newest", "part", "SELECT p_partkey, CASE WHEN i = 5 THEN 99 WHEN p_size = 10 THEN 11 ELSE p_size END AS p_size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i <> 3")
def _(part):
    return _versioned(part).checkout().select("p_partkey", "p_size")


@query("o68a_checkout_first", "part", "SELECT p_partkey, p_size FROM part")
def _(part):
    return _versioned(part).checkout(0).select("p_partkey", "p_size")


@query("o68a_restore", "part", "SELECT p_partkey, p_size FROM part")
def _(part):
    held = _versioned(part)
    held.restore(0)
    return held.checkout().select("p_partkey", "p_size")


# --- predicates (O-20 to O-25) through filter_rows (O-27)
_PREDICATES = {
    "o20_eq": ("orders", "o_orderkey", "o_orderstatus", "eq", "F", "o_orderstatus = 'F'"),
    "o20_ne": ("orders", "o_orderkey", "o_orderstatus", "ne", "F", "o_orderstatus <> 'F'"),
    "o20_gt_typed": ("customer", "c_custkey", "c_acctbal", "gt", "5000", "c_acctbal > 5000"),
    "o20_gte": ("part", "p_partkey", "p_size", "gte", "30", "p_size >= 30"),
    "o20_lt": ("part", "p_partkey", "p_size", "lt", 10, "p_size < 10"),
    "o20_lte": ("lineitem", "l_orderkey", "l_quantity", "lte", "2", "l_quantity <= 2"),
    "o21_contains": ("documents", "doc_id", "text", "contains", "the of", "contains(text, 'the of')"),
    "o21_not_contains": ("documents", "doc_id", "text", "not_contains", "the", "NOT contains(text, 'the')"),
    "o21_startswith": ("documents", "doc_id", "text", "startswith", "The", "starts_with(text, 'The')"),
    "o21_endswith": ("documents", "doc_id", "text", "endswith", ".", "ends_with(text, '.')"),
    "o22_regex": ("documents", "doc_id", "text", "regex", "[0-9]{3}\\.[0-9]", "regexp_matches(text, '[0-9]{3}\\.[0-9]')"),
    "o23_length_gte": ("documents", "doc_id", "text", "length_gte", 3000, "length(text) >= 3000"),
    "o23_words_lt": ("documents", "doc_id", "text", "words_lt", "50", "len(string_split(text, ' ')) < 50"),
    "o25_in": ("customer", "c_custkey", "c_nationkey", "in", "1, 3,5", "c_nationkey IN (1, 3, 5)"),
    "o25_not_in": ("customer", "c_custkey", "c_mktsegment", "not_in", ["BUILDING", "MACHINERY"], "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "o25_in_many": ("orders", "o_orderkey", "o_custkey", "in", list(range(0, 1000)), "o_custkey BETWEEN 0 AND 999"),
}
for _name, (_t, _key, _c, _op, _v, _where) in _PREDICATES.items():
    query(_name, _t, f"SELECT {_key}, {_c} FROM {_t} WHERE {_where}")(lambda df, k=_key, c=_c, op=_op, v=_v: rows.filter_rows(df, c, op, v).select(k, c))


@query("o24_is_null", "documents labels", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def _(documents, labels):
    return rows.filter_rows(combine.join(documents, labels, ["doc_id"], how="left"), "quality", "is_null").select("doc_id")


@query("o24_is_not_null", "documents labels", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def _(documents, labels):
    return rows.filter_rows(combine.join(documents, labels, ["doc_id"], how="left"), "quality", "is_not_null").select("doc_id", "quality")


@query("o27_filters_anded", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND starts_with(o_orderpriority, '1')")
def _(orders):
    return predicates.apply_filters(
        orders,
        [{"column": "o_orderstatus", "operator": "eq", "value": "O"}, {"column": "o_totalprice", "operator": "gte", "value": "100000"}, {"column": "o_orderpriority", "operator": "startswith", "value": "1"}],
    ).select("o_orderkey")


@query("o28_filter_range", "orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'")
def _(orders):
    return rows.filter_range(orders, "o_orderdate", "1995-01-01", "1995-12-31").select("o_orderkey", "o_orderdate")


@query("o29_filter_keywords", "conversations", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(text), 'que')")
def _(conversations):
    return rows.filter_keywords(conversations, "text", ["THE", "que"]).select("conv_id", "turn")


@query("o29_filter_keywords_exclude", "conversations", "SELECT conv_id, turn FROM conversations WHERE NOT (contains(text, 'the') OR contains(text, 'ou'))")
def _(conversations):
    return rows.filter_keywords(conversations, "text", ["the", "ou"], case_sensitive=True, exclude=True).select("conv_id", "turn")


@query("o30_drop_nulls", "documents labels", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND nullif(toxic, 1) IS NOT NULL")
def _(documents, labels):
    joined = combine.join(documents, labels, ["doc_id"], how="left").withColumn("toxic", F.nullif("toxic", F.lit(1)))
    return rows.drop_nulls(joined, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


@query("o31_flag_rows", "documents labels", "SELECT doc_id, coalesce(quality = 1, false) AS good FROM documents LEFT JOIN labels USING (doc_id)")
def _(documents, labels):
    return rows.flag_rows(combine.join(documents, labels, ["doc_id"], how="left"), "quality", "eq", "1", "good").select("doc_id", "good")


# --- columns (O-32 to O-40)
@query("o32_select_columns", "customer", "SELECT c_name, c_custkey FROM customer")
def _(customer):
    return columns.select_columns(customer, ["c_name", "c_custkey"])


@query("o33_drop_columns", "customer", "SELECT * EXCLUDE (c_nationkey) FROM customer")
def _(customer):
    return columns.drop_columns(customer, ["c_nationkey"])


@query("o34_rename_swap", "customer", "SELECT c_nationkey AS c_custkey, c_custkey AS c_nationkey, c_name FROM customer")
def _(customer):
    return columns.rename_columns(customer, {"c_custkey": "c_nationkey", "c_nationkey": "c_custkey"}).select("c_custkey", "c_nationkey", "c_name")


@query("o35_cast_integer", "orders", "SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS BIGINT) AS level, TRY_CAST(o_orderpriority AS BIGINT) AS bad FROM orders")
def _(orders):
    shown = orders.withColumn("level", F.left("o_orderpriority", F.lit(1)))
    return columns.cast_column(columns.cast_column(shown, "level", "integer"), "o_orderpriority", "integer", "bad").select("o_orderkey", "level", "bad")


@query("o35_cast_boolean_and_string", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS done, CAST(o_custkey AS VARCHAR) AS who FROM orders")
def _(orders):
    shown = orders.withColumn("done", F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("open"))
    return columns.cast_column(columns.cast_column(shown, "done", "boolean"), "o_custkey", "string", "who").select("o_orderkey", "done", "who")


@query("o35_cast_date", "orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS DOUBLE) AS key_float FROM orders")
def _(orders):
    return columns.cast_column(columns.cast_column(orders, "o_orderdate", "date", "day"), "o_orderkey", "float", "key_float").select("o_orderkey", "day", "key_float")


@query("o35_cast_text_to_datetime", "orders", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(orders):
    shown = orders.withColumn("shown", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return columns.cast_column(shown, "shown", "date", "day").select("o_orderkey", "day")


_GAPS = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def _gaps(events):
    return events.select("event_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("value")).alias("value"), "event_type")


for _s, _sql in {
    "value": f"coalesce({_GAPS}, 7)", "zero": f"coalesce({_GAPS}, 0)", "mean": f"coalesce({_GAPS}, (SELECT avg({_GAPS}) FROM events))", "median": f"coalesce({_GAPS}, (SELECT median({_GAPS}) FROM events))",
    "min": f"coalesce({_GAPS}, (SELECT min({_GAPS}) FROM events))", "max": f"coalesce({_GAPS}, (SELECT max({_GAPS}) FROM events))",
    "forward": f"last_value({_GAPS} IGNORE NULLS) OVER (ORDER BY event_id)", "backward": f"first_value({_GAPS} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}.items():
    query(f"o36_fill_{_s}", "events", f"SELECT event_id, round({_sql}, 6) AS value FROM events")(
        lambda events, s=_s: columns.fill_missing(_gaps(events), "value", s, 7, order="event_id", block_rows=1000).select("event_id", r6("value").alias("value"))
    )


@query(
    "o36_fill_mode", "events",
    "SELECT event_id, coalesce(nullif(event_type, 'view'), (SELECT event_type FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type FROM events",
)
def _(events):
    return columns.fill_missing(events.withColumn("event_type", F.nullif("event_type", F.lit("view"))), "event_type", "mode").select("event_id", "event_type")


@query("o37_replace_values", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders")
def _(orders):
    return columns.replace_values(orders, "o_orderstatus", {"F": "done", "P": None}, "status").select("o_orderkey", "status")


@query("o37_replace_many", "orders", "SELECT o_orderkey, CASE WHEN o_custkey BETWEEN 1 AND 300 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders")
def _(orders):
    return columns.replace_values(orders, "o_custkey", {k: k + 1_000_000 for k in range(1, 301)}).select("o_orderkey", "o_custkey")


@query("o38_concat_columns", "customer", "SELECT c_custkey, concat(coalesce(nullif(c_mktsegment, 'BUILDING'), ''), '-', c_nationkey) AS label FROM customer")
def _(customer):
    return columns.concat_columns(customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))), ["c_mktsegment", "c_nationkey"], "label", "-").select("c_custkey", "label")


@query("o39_unnest_struct", "customer", "SELECT c_custkey, c_name, c_nationkey AS place_c_custkey, c_nationkey * 2 AS twice FROM customer")
def _(customer):
    nested = customer.select("c_custkey", "c_name", F.struct(F.col("c_nationkey").alias("c_custkey"), (F.col("c_nationkey") * 2).alias("twice")).alias("place"))
    return columns.unnest_struct(nested, "place")


@query("o40_extract_struct_field", "customer", "SELECT c_custkey, c_nationkey AS found FROM customer")
def _(customer):
    nested = customer.select("c_custkey", F.struct(F.struct(F.col("c_nationkey").alias("key")).alias("nation")).alias("place"))
    return columns.extract_field(nested, "place", "nation.key", "found").select("c_custkey", "found")


@query("o40_extract_field", "events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(events):
    return columns.extract_field(events, "props", "k", "k").select("event_id", "k")


# --- joins and sets (O-41 to O-45, O-19)
@query(
    "o41_concat", "customer supplier",
    "SELECT c_acctbal AS balance, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment FROM customer UNION ALL SELECT s_acctbal, s_name, NULL FROM supplier",
)
def _(customer, supplier):
    a = customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    b = supplier.select(F.col("s_name").alias("key"), F.col("s_acctbal").alias("balance"))
    return combine.concat([a, b])


_JOINS = {
    "inner": "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)",
    "left": "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)",
    "right": "SELECT doc_id, lang, quality FROM documents RIGHT JOIN labels USING (doc_id)",
    "full": "SELECT d.doc_id, d.lang, l.quality, l.doc_id AS doc_id_right FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "semi": "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)",
    "anti": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
}
for _how, _sql in _JOINS.items():
    query(f"o42_join_{_how}", "documents labels", _sql)(lambda d, lab, how=_how: combine.join(d.select("doc_id", "lang"), lab.select("doc_id", "quality"), ["doc_id"], how=how))


@query("o42_join_clash", "customer nation", "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, n_name AS name_right FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(customer, nation):
    a = customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("name"))
    return combine.join(a, b, ["nation"], ["nk"])


@query("o42_join_cross", "region supplier", "SELECT r_name, s_name FROM region CROSS JOIN supplier")
def _(region, supplier):
    return combine.join(region.select("r_name"), supplier.select("s_name"), [], how="cross")


@query(
    "o43_merge", "documents labels",
    "SELECT doc_id, d.n_chars, l.quality AS v, m.toxic AS v_right FROM (SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0) d FULL JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id) FULL JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) m USING (doc_id)",
)
def _(documents, labels):
    even = documents.where("doc_id % 2 = 0").select("doc_id", "n_chars")
    return combine.merge([even, labels.select("doc_id", F.col("quality").alias("v")), labels.where("toxic = 1").select("doc_id", F.col("toxic").alias("v"))], ["doc_id"])


@query(
    "o43_merge_all", "documents labels",
    "SELECT doc_id, d.n_chars, l.quality AS v, m.toxic AS v_right FROM documents d FULL JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id) FULL JOIN (SELECT doc_id, toxic FROM labels WHERE toxic = 1) m USING (doc_id)",
)
def _(documents, labels):
    return combine.merge([documents.select("doc_id", "n_chars"), labels.select("doc_id", F.col("quality").alias("v")), labels.where("toxic = 1").select("doc_id", F.col("toxic").alias("v"))], ["doc_id"])


@query("o45_combined_groups", "orders customer", "SELECT c_mktsegment, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(orders, customer):
    return reshape.group_aggregate(combine.join(orders, customer, ["o_custkey"], ["c_custkey"]), ["c_mktsegment"], "count")


@query("o19_separate", "orders", "SELECT o_orderpriority AS value, replace(o_orderpriority, '/', '_') AS part, count(*) AS \"rows\" FROM orders GROUP BY 1")
def _(orders):
    return combine.split_values(orders, "o_orderpriority")


# --- distinct, groups, lists (O-48 to O-51)
@query("o48_dedupe_subset", "documents", "SELECT DISTINCT ON (text) doc_id, lang, n_chars FROM documents ORDER BY text, doc_id")
def _(documents):
    return rows.dedupe(documents, ["text"], ["doc_id"]).select("doc_id", "lang", "n_chars")


@query("o48_dedupe_all", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(lineitem):
    return rows.dedupe(lineitem.select("l_returnflag", "l_linestatus"))


_AGGREGATES = {
    "count": ("orders", ["o_orderstatus"], None, "count(*) AS count"),
    "sum": ("lineitem", ["l_returnflag", "l_linestatus"], "l_quantity", "sum(l_quantity)"),
    "mean": ("lineitem", ["l_returnflag"], "l_extendedprice", "round(avg(l_extendedprice), 6)"),
    "median": ("lineitem", ["l_returnflag"], "l_quantity", "median(l_quantity)"),
    "min": ("orders", ["o_orderpriority"], "o_totalprice", "min(o_totalprice)"),
    "max": ("orders", ["o_orderpriority"], "o_totalprice", "max(o_totalprice)"),
    "n_unique": ("orders", ["o_orderstatus"], "o_custkey", "count(DISTINCT o_custkey)"),
}
for _agg, (_t, _by, _c, _sql) in _AGGREGATES.items():
    query(f"o49_group_{_agg}", _t, f"SELECT {', '.join(_by)}, {_sql}{'' if _c is None else f' AS {_c}_{_agg}'} FROM {_t} GROUP BY ALL")(
        lambda df, agg=_agg, by=_by, c=_c: (lambda g: g.withColumn(f"{c}_mean", r6(f"{c}_mean")) if agg == "mean" else g)(reshape.group_aggregate(df, by, agg, c))
    )


@query("o49_group_first", "conversations", "SELECT conv_id, arg_min(text, turn) AS opening FROM conversations GROUP BY conv_id")
def _(conversations):
    return reshape.group_aggregate(conversations, ["conv_id"], "first", "text", "opening", ["turn"])


@query("o49_group_list", "conversations", "SELECT conv_id, array_to_string(list(role ORDER BY turn), ',') AS roles FROM conversations GROUP BY conv_id")
def _(conversations):
    return reshape.group_aggregate(conversations, ["conv_id"], "list", "role", "roles", ["turn"]).withColumn("roles", F.array_join("roles", ","))


@query("o49_n_unique_with_null", "orders", "SELECT o_orderstatus, count(DISTINCT nullif(o_orderpriority, '5-LOW')) + max((o_orderpriority = '5-LOW')::INT) AS kinds FROM orders GROUP BY 1")
def _(orders):
    return reshape.group_aggregate(orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))), ["o_orderstatus"], "n_unique", "o_orderpriority", "kinds")


@query("o50_value_counts", "lineitem", "SELECT l_linestatus AS value, count(*) AS count FROM lineitem GROUP BY 1")
def _(lineitem):
    return reshape.value_counts(lineitem, "l_linestatus")


@query("o50_value_counts_top", "orders", "SELECT o_custkey AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(orders):
    return reshape.value_counts(orders, "o_custkey", 10)


@query("o51_explode_list", "embeddings", "SELECT vec_id, round(CAST(unnest(embedding) AS DOUBLE), 6) AS embedding FROM embeddings")
def _(embeddings):
    return reshape.explode_list(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding").withColumn("embedding", r6("embedding"))


# --- order, samples, pages (O-52 to O-57)
@query("o52_sort_rows", "part", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 100")
def _(part):
    return rows.sort_rows(part, ["p_size"], True, ["p_partkey"]).select("p_partkey", "p_size").limit(100)


@query("o52_sort_rows_all", "part", "SELECT row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_partkey) - 1 AS row_id, p_partkey, p_size FROM part")
def _(part):
    # The ids ascend along the sorted rows; written, since they hold for one run of the sort only.
    path = scratch(part.sparkSession, "sorted")
    sinks.write(rows.sort_rows(part.select("p_partkey", "p_size"), ["p_size"], True, ["p_partkey"]).withColumn("place", F.monotonically_increasing_id()), path, "parquet")
    return number_rows(load(part.sparkSession, path, "parquet"), ["place"]).select("row_id", "p_partkey", "p_size")


@query("o53_top_n", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(orders):
    return rows.top_n(orders, "o_totalprice", 25, order_by=["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("o54_limit_rows", "documents", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 40")
def _(documents):
    return rows.limit_rows(documents.select("doc_id", "source"), 40, ["doc_id"])


@query("o55_sample_rows", "orders", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(concat_ws('|', 42, o_orderkey)), o_orderkey LIMIT 500")
def _(orders):
    return rows.sample_rows(orders.select("o_orderkey", "o_orderstatus"), 500, 42, ["o_orderkey"])


@query("o55_sample_size", "orders", "SELECT least(500, count(*)) AS n FROM orders")
def _(orders):
    return rows.sample_rows(orders, 500, 42, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("o56_page", "orders", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(orders):
    paged = rows.page(orders, 100, 50, [{"column": "o_orderstatus", "operator": "eq", "value": "F"}], [{"column": "o_orderpriority"}, {"column": "o_totalprice", "descending": True}], ["o_orderkey"])
    return paged.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("o56_page_by_row_id", "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 60")
def _(customer):
    return rows.page(number_rows(customer.select("c_custkey"), ["c_custkey"]), 60, 30, dense=True).select("c_custkey")


@query("o57_get_row", "customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 77")
def _(customer):
    return rows.get_row(number_rows(customer, ["c_custkey"]), 77).select("c_custkey", "c_name")


# --- text (O-80 to O-94)
@query("o80_extract_all", "documents", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+'), ' ') AS found FROM documents")
def _(documents):
    return text.extract_pattern(documents, "text", "found", pattern="[a-z0-9.]+@[a-z0-9.]+").select("doc_id", F.array_join("found", " ").alias("found"))


@query("o80_extract_first", "documents", "SELECT doc_id, nullif(regexp_extract(text, '[0-9]+'), '') AS found FROM documents")
def _(documents):
    return text.extract_pattern(documents, "text", "found", pattern="[0-9]+", all=False).select("doc_id", "found")


# What each preset matches in texts of ASCII, told by patterns of another make.
for _preset, (_t, _key, _c, _pattern) in {
    "email": ("documents", "doc_id", "text", r"[[:alnum:]_.%+-]+@[[:alnum:].-]+[.][A-Za-z][A-Za-z]+"), "phone": ("documents", "doc_id", "text", r"[+]?[0-9][0-9\s().-]{6}[0-9\s().-]*[0-9]"),
    "url": ("pages", "page_id", "url", r"http(?:s|):[/][/][^]\s<>\"'')]+"), "number": ("documents", "doc_id", "text", r"(?:-|)[0-9]+(?:[,.][0-9]+|)"), "hashtag": ("documents", "doc_id", "text", r"#[\p{L}\p{M}\p{Nd}\p{Pc}]+"),
    "mention": ("documents", "doc_id", "text", r"@[\p{L}\p{M}\p{Nd}\p{Pc}]+"), "date": ("orders", "o_orderkey", "shown", r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{3}|[0-9]{2}))\b"),
}.items():
    _from = "(SELECT o_orderkey, concat(strftime(o_orderdate, '%d/%m/%Y'), ' or ', strftime(o_orderdate, '%Y-%m-%d'), ' not ', o_orderkey, '/1') AS shown FROM orders)" if _t == "orders" else _t

    def _preset_query(df, preset=_preset, key=_key, c=_c):
        if preset == "date":
            df = df.select(key, F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" or "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" not "), F.col(key), F.lit("/1")).alias(c))
        return text.extract_pattern(df, c, "found", preset).select(key, F.array_join("found", " ").alias("found"))

    query("o80_extract_preset" if _preset == "url" else f"o80_preset_{_preset}", _t, f"SELECT {_key}, array_to_string(regexp_extract_all({_c}, '{_pattern}'), ' ') AS found FROM {_from}")(_preset_query)


_METRICS = {
    "o81_length": ("length", "length(text)::INT"), "o82_word_count": ("word_count", "len(string_split(text, ' '))::INT"), "o83_line_count": ("line_count", "(length(text) - length(replace(text, chr(10), '')) + 1)::INT"),
    "o84_digit_count": ("digit_count", "(length(text) - length(regexp_replace(text, '\\p{Nd}', '', 'g')))::INT"),
    "o85_uppercase_ratio": ("uppercase_ratio", "round((length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) / greatest(length(text), 1), 6)"),
}
for _name, (_m, _sql) in _METRICS.items():
    query(_name, "documents", f"SELECT doc_id, {_sql} AS metric FROM documents")(
        lambda df, m=_m: (lambda out: out.withColumn("metric", r6("metric")) if m == "uppercase_ratio" else out)(text.text_metric(df, "text", m, "metric").select("doc_id", "metric"))
    )

_TRANSFORMS = {
    "o86_lowercase": ("documents", "doc_id", "text", "lowercase", "lower(text)"),
    "o86_uppercase": ("conversations", "conv_id", "role", "uppercase", "upper(role)"),
    "o87_strip": ("documents", "doc_id", "text", "strip", "regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g')"),
    "o88_title": ("orders", "o_orderkey", "o_orderpriority", "title", "CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' WHEN '5-LOW' THEN '5-Low' END"),
    "o89_collapse_whitespace": ("documents", "doc_id", "text", "collapse_whitespace", "trim(regexp_replace(text, '[\\s]+', ' ', 'g'))"),
    "o90_remove_punctuation": ("documents", "doc_id", "text", "remove_punctuation", "regexp_replace(text, '[^\\p{L}\\p{M}\\p{Nd}_\\s]', '', 'g')"),
    "o91_remove_html": ("pages", "page_id", "html", "remove_html", "regexp_replace(html, '<[^>]+>', ' ', 'g')"),
    "o92_remove_urls": ("pages", "page_id", "url", "remove_urls", "regexp_replace(url, 'http(?:s|):[/][/][^]\\s<>\"'')]+', '', 'g')"),
    "o92_remove_emails": ("documents", "doc_id", "text", "remove_emails", "regexp_replace(text, '[[:alnum:]_.%+-]+@[[:alnum:].-]+[.][A-Za-z][A-Za-z]+', '', 'g')"),
}
for _name, (_t, _key, _c, _op, _sql) in _TRANSFORMS.items():
    query(_name, _t, f"SELECT {_key}, {_sql} AS out FROM {_t}")(lambda df, k=_key, c=_c, op=_op: text.transform_text(df, c, op, "out").select(k, "out"))


@query("o93_replace_literal", "documents", "SELECT doc_id, replace(text, 'the ', 'THE-') AS out FROM documents")
def _(documents):
    return text.replace_text(documents, "text", "the ", "THE-", new_column="out").select("doc_id", "out")


@query("o93_replace_regex", "pages", "SELECT page_id, regexp_replace(url, '^(https?)://([^/]+)/', '\\2 over \\1 costs $ ', 'g') AS out FROM pages")
def _(pages):
    return text.replace_text(pages, "url", "^(https?)://([^/]+)/", "${2} over $1 costs $$ ", literal=False, new_column="out").select("page_id", "out")


@query("o94_split_text", "pages", "SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x: trim(x)), '|') AS pieces FROM pages")
def _(pages):
    return text.split_text(pages, "url", "pieces", "/").select("page_id", F.array_join("pieces", "|").alias("pieces"))


# --- tags and scores (O-95 to O-99)
@query("o95_keyword_tag", "documents", "SELECT doc_id, CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 'secret' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'other' END AS tag FROM documents")
def _(documents):
    return enrich.keyword_tag(documents, "text", "tag", {"secret": ["Password", "token"], "none": [], "contact": ["@"]}).select("doc_id", "tag")


@query("o95_keyword_tags", "documents", "SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'the') THEN 'en' END, CASE WHEN contains(lower(text), 'que') THEN 'fr' END) AS tags FROM documents")
def _(documents):
    return enrich.keyword_tag(documents, "text", "tags", {"en": ["the"], "fr": ["que"]}, multi=True).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("o96_keyword_score", "documents", "SELECT doc_id, round((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 * 2.0 + (length(lower(text)) - length(replace(lower(text), 'en', ''))) / 2 * -0.5, 6) AS score FROM documents")
def _(documents):
    return enrich.keyword_score(documents, "text", "score", {"the": 2.0, "EN": -0.5}).select("doc_id", r6("score").alias("score"))


@query("o97_weighted_score", "part", "SELECT p_partkey, round(p_size * 2.0 + p_retailprice * 0.01, 6) AS score FROM part")
def _(part):
    return enrich.weighted_score(part, {"p_size": 2.0, "p_retailprice": 0.01}).select("p_partkey", r6("score").alias("score"))


@query("o98_completeness_score", "documents", "SELECT doc_id, round(((length(text) > 0)::INT + (length(lang) > 0)::INT) / 2 + least(1.0, log10(length(text) + length(lang) + 1) / 6), 6) AS score FROM documents")
def _(documents):
    return enrich.completeness_score(documents, "score", ["text", "lang"]).select("doc_id", r6("score").alias("score"))


@query("o99_bucketize", "part", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN '(-inf, 10]' WHEN p_size <= 30 THEN '(10, 30]' ELSE '(30, inf]' END AS bucket FROM part")
def _(part):
    return enrich.bucketize(part, "p_size", [10, 30], "bucket").select("p_partkey", "bucket")


@query("o99_bucketize_labels", "customer", "SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 'debt' WHEN c_acctbal <= 5000 THEN 'some' ELSE 'rich' END AS bucket FROM customer")
def _(customer):
    return enrich.bucketize(customer, "c_acctbal", [0, 5000], "bucket", ["debt", "some", "rich"]).select("c_custkey", "bucket")


# --- edits (O-60 to O-66b)
_KEYED = "o_orderkey, o_orderstatus, o_totalprice"


@query(
    "o60_apply_changes", "orders",
    "SELECT o_orderkey, CASE WHEN o_orderkey = 2 THEN NULL WHEN o_orderkey = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 3 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey <> 1 UNION ALL SELECT 1099511627776, 'N', NULL",
)
def _(orders):
    keyed = orders.selectExpr("o_orderkey", "o_orderstatus", "o_totalprice")
    return edits.apply_changes(
        keyed,
        [
            {"op": "update", "row_id": 1, "values": {"o_orderstatus": "Z"}}, {"op": "update", "row_id": 2, "values": {"o_orderstatus": None}}, {"op": "delete", "row_id": 1}, {"op": "update", "row_id": 1, "values": {"o_totalprice": 0}},
            {"op": "update", "row_id": 3, "values": {"o_orderstatus": "X"}}, {"op": "update", "row_id": 3, "values": {"o_totalprice": "1.5"}}, {"op": "add", "row": {"o_orderstatus": "N"}},
        ],
        "o_orderkey",
    )


@query(
    "o60_change_table", "orders",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'E' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 1 THEN 10.0 ELSE o_totalprice END AS o_totalprice FROM (SELECT {_KEYED} FROM orders) WHERE o_orderkey % 7 <> 0",
)
def _(orders):
    keyed = orders.selectExpr("o_orderkey", "o_orderstatus", "o_totalprice")
    some = keyed.where("o_orderkey % 5 = 1").select("o_orderkey")
    make = lambda seq, op, c, v, of: of.select(F.lit(seq).alias("seq"), "o_orderkey", F.lit(op).alias("op"), F.lit(c).alias("column"), F.lit(v).alias("value"))
    changes = make(1, "update", "o_orderstatus", "D", some).union(make(2, "update", "o_orderstatus", "E", some)).union(make(3, "update", "o_totalprice", "10.0", some))
    changes = changes.union(make(4, "delete", None, None, keyed.where("o_orderkey % 7 = 0").select("o_orderkey")))
    return edits.apply_change_table(keyed, changes, "o_orderkey")


@query("o64_replace_exact", "orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'filled' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(orders):
    return edits.find_replace(orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "f", "filled", ignore_case=True)


@query("o65_replace_contains", "documents", "SELECT doc_id, regexp_replace(text, '(?i)the', '$1', 'g') AS text FROM documents")
def _(documents):
    return edits.find_replace(documents.select("doc_id", "text"), "text", "THE", "$1", "contains", True)


@query("o65_replace_regex", "documents", "SELECT doc_id, regexp_replace(text, '([0-9]+)\\.([0-9]+)', '\\2.\\1', 'g') AS text FROM documents")
def _(documents):
    return edits.find_replace(documents.select("doc_id", "text"), "text", "([0-9]+)\\.([0-9]+)", "$2.$1", "regex")


@query("o66_count_matches", "documents", "SELECT count(*) FILTER (contains(lower(text), 'token')) AS matches FROM documents")
def _(documents):
    return edits.count_matches(documents, "text", "TOKEN", "contains", True)


@query("o66a_transform_rows", "part", "SELECT row_number() OVER (ORDER BY p_size DESC NULLS LAST, p_partkey) - 1 AS row_id, p_partkey, p_size FROM part WHERE p_size > 20")
def _(part):
    numbered = number_rows(part.select("p_partkey", "p_size"), ["p_partkey"])
    steps = [{"op": "filter_rows", "params": {"column": "p_size", "operator": "gt", "value": 20}}, {"op": "sort_rows", "params": {"columns": ["p_size"], "descending": True}}]
    return edits.transform_rows(numbered, steps).select("row_id", "p_partkey", "p_size")


def _edits_of(part):
    """An edit for every part: each third is deleted, each even one of the others updated twice."""
    two = F.array(F.struct(F.lit(1).alias("seq"), F.lit("update").alias("op")), F.struct(F.lit(2).alias("seq"), F.lit("update").alias("op")))
    made = F.when(F.col("p_partkey") % 3 == 0, F.array(F.struct(F.lit(1).alias("seq"), F.lit("delete").alias("op")))).when(F.col("p_partkey") % 2 == 0, two)
    return part.select(F.col("p_partkey").alias("row_id"), F.explode(made).alias("e")).select("row_id", "e.seq", "e.op")


@query("o66b_change_summary", "part", "SELECT 'delete' AS op, count(*) AS changes, count(*) AS \"rows\" FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'update', 2 * count(*), count(*) FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0")
def _(part):
    return edits.change_summary(_edits_of(part))


# --- versions (O-67 to O-69)
def _edited(orders):
    parent = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    child = parent.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return parent, child


@query("o67_reverse_delta", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 11 <> 0")
def _(orders):
    parent, child = _edited(orders)
    return versions.build_undo(parent, child, ["o_totalprice"], "o_orderkey")[1].select("o_orderkey", "o_totalprice")


@query("o67_delta_counts", "orders", "SELECT 'deleted' AS kind, count(*) AS \"rows\" FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'changed', count(*) FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT 'added', 0")
def _(orders):
    parent, child = _edited(orders)
    deleted, cells = versions.build_undo(parent, child, ["o_totalprice"], "o_orderkey")
    return versions.delta_counts(deleted, cells, child.join(parent.select("o_orderkey"), "o_orderkey", "left_anti"))


@query("o68_rebuild_parent", "orders", f"SELECT {_KEYED} FROM orders")
def _(orders):
    parent, child = _edited(orders)
    deleted, cells = versions.build_undo(parent, child, ["o_totalprice"], "o_orderkey")
    return versions.apply_undo(child, deleted, cells, "o_orderkey")


@query("o68_parent_positions", "part", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS parent_position FROM part QUALIFY parent_position NOT IN (3, 4, 10)")
def _(part):
    numbered = number_rows(part.select("p_partkey"), ["p_partkey"], "position")
    child = number_rows(numbered.where("position NOT IN (3, 4, 10)").select("p_partkey"), ["p_partkey"], "position")
    return versions.parent_positions(child, [3, 4, 10]).select("p_partkey", "parent_position")


@query("o68_parent_positions_many", "part", "SELECT p_partkey, i AS parent_position FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i % 7 NOT IN (0, 1, 5)")
def _(part):
    numbered = number_rows(part.select("p_partkey"), ["p_partkey"], "position")
    gone = F.col("position") % 7
    child = number_rows(numbered.where(~gone.isin(0, 1, 5)).select("p_partkey"), ["p_partkey"], "position")
    return versions.parent_positions(child, numbered.where(gone.isin(0, 1, 5)).select("position")).select("p_partkey", "parent_position")


@query("o69_row_diff", "orders", "(SELECT o_orderkey, o_totalprice, 'removed' AS side FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 4 = 0) UNION ALL (SELECT o_orderkey, o_totalprice + 1, 'added' FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 4 = 0)")
def _(orders):
    parent, child = _edited(orders)
    return versions.row_diff(parent, child, None).select("o_orderkey", "o_totalprice", "side")


def _history(orders) -> versions.Versions:
    """Orders with five commits: F becomes X, each row below 100 goes, O becomes Y, an old version comes back, P becomes Z."""
    held = versions.Versions(orders.sparkSession, scratch(orders.sparkSession, "versions"))
    held.init(number_rows(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderkey"]))
    status = lambda old, new: {"op": "replace", "column": "o_orderstatus", "find": old, "replace": new}
    held.commit([status("F", "X")], "one")
    held.commit([{"op": "delete", "row_id": k} for k in range(100)], "two")
    held.commit([status("O", "Y")], "three")
    held.restore(1)
    held.commit([status("P", "Z")], "five")
    return held


_NUMBERED = "(SELECT o_orderkey, o_orderstatus AS s, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)"


@query(
    "o69_diff_of_versions", "orders",
    f"""
SELECT o_orderkey, CASE WHEN s = 'F' THEN 'X' ELSE s END AS o_orderstatus, o_totalprice, 'removed' AS side FROM {_NUMBERED} WHERE i < 100 OR s = 'O'
UNION ALL SELECT o_orderkey, 'Y', o_totalprice, 'added' FROM {_NUMBERED} WHERE i >= 100 AND s = 'O'
""",
)
def _(orders):
    return _history(orders).row_diff(1, 3)


@query(
    "o69_changes_over_a_restore", "orders",
    f"""
SELECT i AS row_id, CASE WHEN i < 100 THEN NULL WHEN s = 'O' THEN 'Y' ELSE s END AS before, CASE WHEN s = 'P' THEN 'Z' WHEN s = 'F' THEN 'X' ELSE s END AS after
FROM {_NUMBERED} WHERE i < 100 OR s = 'O' OR s = 'P'
""",
)
def _(orders):
    return _history(orders).changes(3, 5).select("row_id", F.col("old.o_orderstatus").alias("before"), F.col("new.o_orderstatus").alias("after"))


@query("o68a_commit_after_a_dead_one", "part", "SELECT p_partkey, CASE WHEN i = 5 THEN 99 WHEN p_size IN (10, 11) THEN 12 ELSE p_size END AS p_size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i <> 3 AND i <> 4")
def _(part):
    held = _versioned(part)
    commits = held.log()
    held._made(commits, versions.Commit(3, "dead", "delta", held._attempt(3)), [{"op": "delete", "row_id": 9}])  # its rows are written, its note isn't
    held.commit([{"op": "replace", "column": "p_size", "find": 11, "replace": 12}, {"op": "delete", "row_id": 4}], "alive")
    return held.checkout().select("p_partkey", "p_size").where("p_size IS NOT NULL")


@query("o68a_concurrent_commits", "part", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 101 WHEN p_size = 2 THEN 102 ELSE p_size END AS p_size FROM part")
def _(part):
    from concurrent.futures import ThreadPoolExecutor

    held = versions.Versions(part.sparkSession, scratch(part.sparkSession, "versions"))
    held.init(number_rows(part.select("p_partkey", "p_size"), ["p_partkey"]))
    writers = [versions.Versions(part.sparkSession, held.path) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: writers[k].commit([{"op": "replace", "column": "p_size", "find": k + 1, "replace": k + 101}]), range(2)))
    return held.checkout().select("p_partkey", "p_size")


# --- profiles (O-70 to O-79b)
@query("o70_overview", "documents", 'SELECT count(*) AS "rows", 3 AS columns, 0.0::DOUBLE AS missing_percent, count(*) - count(DISTINCT (text, lang, n_chars)) AS duplicate_rows FROM documents')
def _(documents):
    return profile.overview(documents.select("text", "lang", "n_chars"))


def _profile_sql(t: str, number: list[str], others: list[tuple[str, str]]) -> str:
    parts = []
    for c in number:
        rank = lambda q, c=c: f"(SELECT {c}::DOUBLE FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL) WHERE i = floor((n - 1) * {q} + 0.5))"
        what = "'integer'" if c in ("l_linenumber", "l_partkey") else "'float'"
        parts.append(
            f"SELECT '{c}' AS \"column\", {what} AS type, count(*) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"unique\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, median({c})::DOUBLE AS median, {rank(0.25)} AS q1, {rank(0.75)} AS q3 FROM {t}"
        )
    for c, what in others:
        parts.append(f"SELECT '{c}', '{what}', count(*), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {t}")
    return " UNION ALL ".join(parts)


@query("o71_profile", "lineitem", _profile_sql("lineitem", ["l_linenumber", "l_quantity", "l_extendedprice"], [("l_returnflag", "string"), ("l_shipdate", "datetime")]))
def _(lineitem):
    out = profile.profile(lineitem.select("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"))
    return out.select("column", "type", "count", "nulls", "unique", "min", "max", r6("mean").alias("mean"), r6("std").alias("std"), "median", "q1", "q3")


@query(
    "o71_profile_approximate", "lineitem",
    "SELECT 'l_extendedprice' AS \"column\", 'float' AS type, count(*) AS count, 0::BIGINT AS nulls, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS in_bins, true AS unique_is_close, true AS median_is_close FROM lineitem"
    " UNION ALL SELECT 'l_quantity', 'float', count(*), 0, min(l_quantity), max(l_quantity), count(*), true, true FROM lineitem UNION ALL SELECT 'l_returnflag', 'string', count(*), 0, NULL, NULL, NULL, true, NULL FROM lineitem",
)
def _(lineitem):
    held = lineitem.select("l_extendedprice", "l_quantity", "l_returnflag")
    about = profile.profile(held, exact=False)
    exact = profile.profile(held).select("column", F.col("unique").alias("u"), F.col("median").alias("m"), (F.col("max") - F.col("min")).alias("spread"))
    in_bins = F.aggregate("histogram", F.lit(0).cast("long"), lambda a, x: a + x)
    close = F.abs(F.col("unique") - F.col("u")) <= F.greatest(F.lit(1.0), 0.08 * F.col("u"))
    joined = about.join(F.broadcast(exact), "column")  # a row for each column
    return joined.select("column", "type", "count", "nulls", "min", "max", in_bins.alias("in_bins"), close.alias("unique_is_close"), (F.abs(F.col("median") - F.col("m")) <= 0.02 * F.col("spread")).alias("median_is_close"))


@query(
    "o71_profile_histogram", "lineitem",
    "WITH b AS (SELECT min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem), c AS (SELECT least(20, greatest(1, ceil((l_extendedprice - lo) / ((hi - lo) / 20))))::INT AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)"
    " SELECT k::INT AS bin, coalesce(n, 0) AS count FROM range(1, 21) AS t(k) LEFT JOIN c ON bin = k",
)
def _(lineitem):
    out = profile.profile(lineitem.select("l_extendedprice", "l_returnflag")).where("histogram IS NOT NULL")
    return out.select(F.posexplode("histogram").alias("at", "count")).select((F.col("at") + 1).alias("bin"), "count")


@query(
    "o71_top_values", "orders",
    "SELECT * FROM (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2) QUALIFY row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, value) <= 3",
)
def _(orders):
    return profile.top_values(orders.select("o_orderstatus", "o_orderpriority", "o_totalprice"), 3)


@query("o72_systematic_sample", "events", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i % greatest(1, ceil(n / 1000)::BIGINT) = 0")
def _(events):
    numbered = number_rows(events.select("event_id"), ["event_id"])
    return profile.systematic_sample(numbered, events.count(), most=1000).select("event_id")


_HISTOGRAM = (
    "WITH b AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count({c}) AS n FROM {t}), v AS (SELECT CASE WHEN hi > lo THEN least({k}, greatest(1, ceil(({c}::DOUBLE - lo) / ((hi - lo) / {k})))) ELSE 1 END::INT AS bin FROM {t}, b WHERE {c} IS NOT NULL), "
    "e AS (SELECT unnest(range(1, {k} + 1))::INT AS bin) SELECT e.bin, count(v.bin) AS count, round(sum(count(v.bin)) OVER (ORDER BY e.bin) / (SELECT n FROM b), 6) AS cumulative_share FROM e LEFT JOIN v ON e.bin = v.bin GROUP BY e.bin"
)


@query("o73_histogram", "lineitem", _HISTOGRAM.format(c="l_extendedprice", t="lineitem", k=20))
def _(lineitem):
    return profile.histogram(lineitem, "l_extendedprice").select("bin", "count", r6("cumulative_share").alias("cumulative_share"))


@query("o73_histogram_integers", "part", _HISTOGRAM.format(c="p_size", t="part", k=7))
def _(part):
    return profile.histogram(part, "p_size", 7).select("bin", "count", r6("cumulative_share").alias("cumulative_share"))


@query(
    "o74_quantile", "lineitem",
    "SELECT max(CASE WHEN i = floor((n - 1) * 0.25 + 0.5) THEN v END) AS q1, max(CASE WHEN i = floor((n - 1) * 0.5 + 0.5) THEN v END) AS q2, max(CASE WHEN i = floor((n - 1) * 0.75 + 0.5) THEN v END) AS q3 FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)",
)
def _(lineitem):
    return profile.quantile(lineitem, "l_extendedprice").select(F.col("q_0").alias("q1"), F.col("q_1").alias("q2"), F.col("q_2").alias("q3"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(
    "o75_correlations", "lineitem",
    " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) AS r FROM lineitem" for p in _PAIRS for x, y in (p, p[::-1])) + "".join(f" UNION ALL SELECT '{c}', '{c}', 1.0" for c in ("l_quantity", "l_extendedprice", "l_discount")),
)
def _(lineitem):
    return profile.correlations(lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", r6("r"))


@query("o79a_strongest_correlations", "lineitem", "SELECT 'l_net' AS a, 'l_quantity' AS b, round(corr(l_quantity * 10 + l_discount * 100, l_quantity), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', 'l_net', round(corr(l_quantity * 10 + l_discount * 100, l_discount), 6) FROM lineitem HAVING abs(corr(l_quantity * 10 + l_discount * 100, l_discount)) >= 0.3")
def _(lineitem):
    held = lineitem.withColumn("l_net", F.col("l_quantity") * 10 + F.col("l_discount") * 100)
    return profile.strongest_correlations(held, ["l_quantity", "l_net", "l_discount"]).withColumn("r", r6("r"))


@query(
    "o76_missing_pairs", "documents labels",
    "WITH j AS (SELECT nullif(lang, 'en') AS lang, nullif(quality, 1) AS quality, nullif(toxic, 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT unnest(list_filter([CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END], lambda x: x IS NOT NULL)) AS a, list_filter([CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END], lambda x: x IS NOT NULL) AS bs FROM j), d AS (SELECT a, unnest(bs) AS b FROM c) SELECT a, b, count(*) AS \"rows\" FROM d GROUP BY a, b",
)
def _(documents, labels):
    joined = combine.join(documents.select("doc_id", "lang"), labels, ["doc_id"], how="left")
    return profile.missing_pairs(joined.select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), F.nullif("quality", F.lit(1)).alias("quality"), F.nullif("toxic", F.lit(1)).alias("toxic")))


@query("o77_distribution_text", "documents", "SELECT substring(source, 1, 200) AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(documents):
    return profile.distribution(documents, "source")


@query("o77_distribution_summary", "embeddings", "SELECT count(*) AS total, count(DISTINCT x) AS \"unique\", least(count(DISTINCT x), 50) AS shown, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def _(embeddings):
    return profile.distribution_summary(embeddings, "embedding").select("total", "unique", "shown", *[r6(c).alias(c) for c in ("min", "max", "mean")])


@query("o77_distribution_list", "embeddings", _HISTOGRAM.format(c="x", t="(SELECT unnest(embedding) AS x FROM embeddings)", k=50))
def _(embeddings):
    return profile.distribution(embeddings, "embedding").select("bin", "count", r6("cumulative_share").alias("cumulative_share"))


_NEAREST = "(SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = floor((n - 1) * {q} + 0.5))"


@query("o78_outliers_iqr", "orders", f"WITH b AS (SELECT {_NEAREST.format(q=0.25)} AS q1, {_NEAREST.format(q=0.75)} AS q3) SELECT o_orderkey, o_totalprice FROM orders, b WHERE o_totalprice < q1 - 0.2 * (q3 - q1) OR o_totalprice > q3 + 0.2 * (q3 - q1)")
def _(orders):
    return profile.outliers(orders, "o_totalprice", "iqr", 0.2).select("o_orderkey", "o_totalprice")


@query("o78_outliers_zscore", "customer", "SELECT c_custkey, c_acctbal FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) WHERE abs(c_acctbal - m) / s > 1.6")
def _(customer):
    return profile.outliers(customer, "c_acctbal", "zscore", 1.6).select("c_custkey", "c_acctbal")


@query(
    "o79b_column_roles", "orders",
    "WITH p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS u, count(DISTINCT {c}) * 100.0 / count(*) AS p FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")) + ") SELECT \"column\", CASE WHEN u <= 1 THEN 'Constant' WHEN u <= 20 OR p < 5 THEN 'Categories' WHEN p >= 90 THEN 'Identifier-like' ELSE 'Mixed' END AS role FROM p",
)
def _(orders):
    return profile.column_roles(profile.profile(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")))


# --- search (O-100 to O-103)
_HAY = "lower(concat_ws(chr(10), CAST(doc_id AS VARCHAR), text, lang, source, CAST(n_chars AS VARCHAR)))"


@query("o100_search", "documents", f"SELECT doc_id FROM documents WHERE contains({_HAY}, 'token') AND contains({_HAY}, 'en')")
def _(documents):
    return search.search(documents, "Token EN").select("doc_id")


@query("o100_search_page", "conversations", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn LIMIT 20 OFFSET 10")
def _(conversations):
    return search.search_page(conversations, "THE", ["conv_id", "turn"], ["text"], 10, 20).select("conv_id", "turn")


@query("o101_highlights", "documents", "SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'src1') THEN 'text' END, CASE WHEN contains(lower(source), 'src1') THEN 'source' END) AS where_found FROM documents WHERE contains(lower(text), 'src1') OR contains(lower(source), 'src1')")
def _(documents):
    found = search.highlights(search.search(documents, "src1"), "src1")
    return found.select("doc_id", F.array_join(F.map_keys("highlights"), ",").alias("where_found"))


@query("o102_text_index", "conversations", "SELECT token, array_to_string(list_sort(list(DISTINCT block)), ',') AS blocks FROM (SELECT floor(conv_id / 20)::BIGINT AS block, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS token FROM conversations) GROUP BY token")
def _(conversations):
    index = search.index_rows(conversations.select(F.col("conv_id").alias("row_id"), "text"), 20)
    index = index.groupBy("token").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "blocks"))), lambda x: x["blocks"])).alias("blocks"))
    return index.select("token", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))


_INDEXES: dict[tuple[str, str], search.TextIndex] = {}


def _index_of(spark, sf_dir: str) -> search.TextIndex:
    """The word index of documents, built and opened once for a session and a folder of tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXES:
        path = scratch(spark, "index")
        documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        search.build_index(documents.select(F.col("doc_id").alias("row_id"), "text"), path, 50)
        _INDEXES[key] = search.TextIndex(spark, path)
    return _INDEXES[key]


def _search_indexed(words: str):
    return lambda spark, sf_dir: _index_of(spark, sf_dir).search(words).select(F.col("row_id").alias("doc_id"))


# A common word and one inside which many words lie; a stretch inside one rare word.
QUERIES["o103_search_indexed"] = _search_indexed("ing TOKEN")
ORACLE_SQL["o103_search_indexed"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'token') AND contains(lower(text), 'ing')"
QUERIES["o103_search_indexed_rare"] = _search_indexed("HSHANN")
ORACLE_SQL["o103_search_indexed_rare"] = "SELECT doc_id FROM documents WHERE contains(lower(text), 'hshann')"


@query("o103_words_with", "documents", "SELECT token FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS token FROM documents) WHERE contains(token, 'kens') OR contains(token, 'ok')")
def _(documents):
    grams = search.index_grams(search.index_rows(documents.select(F.col("doc_id").alias("row_id"), "text"), 50))
    found = search.words_with(grams, ["kens", "ok"], 10**6)
    tokens = sorted({(t,) for ts in found.values() for t in ts})
    return documents.sparkSession.createDataFrame(tokens, "token string")


@query("o100_search_rare", "documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'hshann')")
def _(documents):
    return search.search(documents.select("doc_id", "text"), "HSHANN", ["text"]).select("doc_id")


@query("o70_columns_by_type", "orders", "SELECT CASE WHEN data_type IN ('DOUBLE', 'FLOAT') THEN 'float' WHEN data_type LIKE '%INT%' THEN 'integer' WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' ELSE 'string' END AS type, count(*)::INT AS columns FROM (SELECT column_type AS data_type FROM (DESCRIBE orders)) GROUP BY 1")
def _(orders):
    return profile.columns_by_type(orders)


@query("o59a_preview", "orders", f"SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT {PREVIEW}) WHERE o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT {SHOWN}")
def _(orders):
    steps = [{"op": "filter_range", "params": {"column": "o_totalprice", "min": 100000}}, {"op": "sort_rows", "params": {"columns": ["o_totalprice"], "descending": True}}]
    shown = preview(orders.select("o_orderkey", "o_totalprice"), steps, ["o_orderkey"])
    return orders.sparkSession.createDataFrame([(r["o_orderkey"], r["o_totalprice"], shown["total"]) for r in shown["rows"]], "o_orderkey long, o_totalprice double, total long")


@query("o10_arrow_files", "orders", "SELECT o_orderkey, o_totalprice FROM orders")
def _(orders):
    path = scratch(orders.sparkSession, "arrow")
    arrow_files.write(orders.select("o_orderkey", "o_totalprice"), path)
    return load(orders.sparkSession, path, "arrow")


@query("o10_split_file", "lineitem", "SELECT l_orderkey, l_extendedprice, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey >= 100")
def _(lineitem):
    """Files that several tasks read each, with filters that reach them. Each task of the scan writes one, so that none has all rows."""
    path = scratch(lineitem.sparkSession, "arrow")
    arrow_files.write(lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag"), path)
    return load(lineitem.sparkSession, path, "arrow", splitBytes=200_000).where("l_returnflag = 'R' AND l_orderkey >= 100")


@query("o103_candidate_blocks", "documents", "SELECT block FROM (SELECT DISTINCT floor(doc_id / 50)::BIGINT AS block, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS token FROM documents) WHERE contains(token, 'disgusting') GROUP BY block")
def _(documents):
    held = documents.select(F.col("doc_id").alias("row_id"), "text")
    return search.candidate_blocks(search.index_rows(held, 50), "disgusting")


# --- time windows (O-110; batch here, the same function runs on a stream)
@query("o110_windowed_counts", "events", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def _(events):
    return windowed_counts(events, "ts", "event_type")


@query("o110_first_of_key", "events", "SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(events):
    return first_of_key(events.select("event_id", "ts", "user_id", "event_type"), "user_id", "ts")


@query("o110_dedupe", "events", "SELECT DISTINCT user_id, event_type FROM events")
def _(events):
    twice = events.select("user_id", "event_type", "ts").unionByName(events.select("user_id", "event_type", "ts"))
    return dedupe(twice, ["user_id", "event_type"], "ts").select("user_id", "event_type")
