import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsheet.functions import text, values
from loomsheet.operators import columns, predicates, rows
from loomsheet.operators import text as text_ops


@pytest.fixture(scope="module")
def people(spark):
    data = [("Ann", 30, ("Rome", "1")), ("bob", 25, ("Oslo", "2")), (None, 40, None), ("Éva", 25, ("Rome", None))]
    return spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "row_id long, name string, age long, info struct<city:string,zip:string>")


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("column", "operator", "value", "want"),
    [
        ("age", "eq", "30", [0]), ("age", "ne", 25, [0, 2]), ("age", "gt", "25.5", [0, 2]), ("name", "is_null", None, [2]), ("name", "is_not_null", None, [0, 1, 3]), ("name", "not_contains", "n", [1, 3]),
        ("info", "contains", "Rome", [0, 3]), ("name", "regex", "^é", []), ("name", "regex", "(?i)^é", [3]), ("name", "regex", r"^\w+$", [0, 1, 3]), ("age", "in", "25, 40", [1, 2, 3]), ("name", "not_in", ["Ann"], [1, 3]),
        ("name", "length_gte", "3", [0, 1, 3]), ("name", "words_lt", 2, [0, 1, 3]), ("name", "startswith", "É", [3]), ("name", "endswith", "b", [1]),
    ],
)
def test_predicates(people, column, operator, value, want):
    assert ids(rows.filter_rows(people, column, operator, value)) == want


def test_long_lists_join(people):
    many = list(range(26, 1000))
    assert ids(rows.filter_rows(people, "age", "in", many)) == [0, 2] and ids(rows.filter_rows(people, "age", "not_in", many)) == [1, 3]
    assert rows.filter_rows(people, "age", "in", many).columns == people.columns


def test_errors_are_readable(people):
    for call in (lambda: predicates.predicate(people, "nope", "eq", 1), lambda: predicates.predicate(people, "age", "eq", "old"), lambda: predicates.predicate(people, "age", "like", "x")):
        with pytest.raises(ValueError):
            call()


def test_kinds():
    assert [values.kind(t) for t in (T.StringType(), T.ByteType(), T.DecimalType(20, 0), T.DecimalType(10, 2), T.FloatType(), T.BooleanType(), T.TimestampNTZType(), T.DateType(), T.BinaryType(), T.ArrayType(T.LongType()), T.StructType(), T.NullType(), T.MapType(T.StringType(), T.StringType()))] == [
        "string", "integer", "integer", "float", "float", "boolean", "datetime", "date", "binary", "list", "struct", "null", "unknown",
    ]


def one(spark, column, **data):
    df = spark.createDataFrame([tuple(data.values())], ", ".join(f"{k} string" for k in data))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("name", "given", "want"),
    [
        ("title", "e.t. phone-home o'neil ÉCOLE", "E.T. Phone-Home O'Neil École"), ("strip", " \t x y\n", "x y"), ("collapse_whitespace", " a \n\t b c ", "a b c"), ("remove_punctuation", "é, b! c_d?", "é b c_d"),
        ("remove_html", "<p>x</p>", " x "), ("remove_urls", "see https://a.b/c?d now", "see  now"), ("remove_emails", "to e.x+y@host.org!", "to !"), ("uppercase", "é", "É"), ("lowercase", "É", "é"),
    ],
)
def test_transforms(spark, name, given, want):
    assert one(spark, text.TRANSFORMS[name](F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("pattern", "new", "given", "want"),
    [("(a)(b)", "$2$1", "xab", "xba"), ("(a)", "${1}0", "a", "a0"), ("(?<w>a)", "$w!", "a", "a!"), ("a", "$$", "a", "$"), ("(a)", "$1", "a", "a"), ("a", "\\", "a", "\\"), ("(a)", "<${1}>", "a", "<a>")],
)
def test_replacements(spark, pattern, new, given, want):
    df = spark.createDataFrame([(given,)], "t string")
    assert text_ops.replace_text(df, "t", pattern, new, literal=False).first()[0] == want


@pytest.mark.parametrize("odd", ["a.b", "\\E", "x\\Ey", "$1", "(", "[^"])
def test_literals_stand_for_themselves(spark, odd):
    df = spark.createDataFrame([(f"<{odd}>",)], "t string")
    assert df.where(F.col("t").rlike(values.literal(odd))).count() == 1
    assert text_ops.replace_text(df, "t", odd, "$0\\").first()[0] == "<$0\\>"
    assert [len(r[0]) for r in text_ops.split_text(df, "t", "p", odd).select("p").collect()] == [2]


def test_casts_give_null_where_they_cannot_read(spark):
    df = spark.createDataFrame([("12",), ("1.5",), ("x",), (None,), ("2024-02-29",), ("31/12/2023",), ("2023-02-30",)], "t string")
    assert [r[0] for r in columns.cast_column(df, "t", "integer").collect()] == [12, None, None, None, None, None, None]
    days = [str(r[0]) for r in columns.cast_column(df, "t", "date").collect()]
    assert days[4:6] == ["2024-02-29", "2023-12-31"] and days[2] == days[3] == "None"


def test_fills(spark):
    df = spark.createDataFrame([(i, None if i % 7 else i, None if i < 9 else "v") for i in range(1000)], "row_id long, n long, s string").repartition(5)
    for block in (3, 50, 10_000):
        filled = {r["row_id"]: r["n"] for r in columns.ordered_fill(df, "n", True, "row_id", block).collect()}
        assert filled == {i: i - i % 7 for i in range(1000)}
        back = {r["row_id"]: r["n"] for r in columns.ordered_fill(df, "n", False, "row_id", block).collect()}
        assert all(back[i] == -(-i // 7) * 7 for i in range(994)) and back[999] is None
    assert {r["n"] for r in columns.fill_missing(df, "n", "mean").where("row_id = 1").collect()} == {497}
    assert columns.fill_missing(df, "s", "mode").where("s IS NULL").count() == 0
    with pytest.raises(ValueError):
        columns.fill_missing(df, "s", "mean")
    with pytest.raises(ValueError):
        columns.fill_missing(df, "n", "value", "many")


def test_struct_fields(people):
    out = columns.unnest_struct(people.withColumn("city", F.lit("x")), "info")
    assert out.columns == ["row_id", "name", "age", "city", "info_city", "zip"]
    assert [r["c"] for r in columns.extract_field(people, "info", "city", "c").orderBy("row_id").collect()] == ["Rome", "Oslo", None, "Rome"]
