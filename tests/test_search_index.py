"""The written word index: equal to a scan, and reading little where little can match."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsheet.operators import search
from loomsheet.operators.search import TextIndex


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeinort") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(12)) + (" rarity x-ray" if k == 1_234 else "") + (f" Été{k}" if k % 400 == 0 else ""), float(k % 7)) for k in range(2_000)]
    return spark.createDataFrame(rows, "row_id long, text string, score double")


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ix") / "i")
    search.build_index(table, path, 50)
    return TextIndex(spark, path)


@pytest.mark.parametrize("query", ["rarity", "RIT", "x-ray", "y ra", "e", "in on", "été", "é", "t80", "a 3.0", "absent", "---", "rarity absent", "in rarity"])
def test_equal_to_the_scan(table, index, query):
    want = sorted(r["row_id"] for r in search.search(table, query, ["text", "score"]).collect())
    assert sorted(r["row_id"] for r in index.search(query).collect()) == want


def test_rare_words_read_one_block_and_common_ones_all(index, monkeypatch):
    assert index.ranges("arit") == [(24, 24)] and index.ranges("absent") == [] and index.ranges("---") is None and index.ranges("e") is None
    assert len(index.ranges("été")) == 5
    plan = index.search("arit")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_id,1200), LessThanOrEqual(row_id,1249)" in plan
    monkeypatch.setattr(search, "WORDS", 3)
    assert search.words_with(index.grams, ["e", "arit"], 3) == {"arit": ["rarity"]}


def test_the_look_up_pushes_grams_and_words(index):
    found = {"arit": ["rarity"], "ray": ["ray", "raye"]}
    plan = search.blocks_with(index.words, found)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,rarity)" in plan


def test_grams_of_short_words(spark):
    words = spark.createDataFrame([("a", [0]), ("abcd", [1]), ("日本", [2])], "token string, blocks array<long>")
    assert {tuple(r) for r in search.index_grams(words).collect()} == {("a", "a"), *((g, "abcd") for g in ("a", "b", "c", "d", "ab", "bc", "cd", "abc", "bcd")), ("日", "日本"), ("本", "日本"), ("日本", "日本")}


def test_a_place_of_a_word_has_one_row(spark, index):
    chars = index.words.select("token").distinct().agg(F.sum(F.char_length("token"))).first()[0]
    assert index.grams.count() == chars


def test_stretches_find_what_grams_find(spark):
    words = spark.createDataFrame([(w, [k]) for k, w in enumerate(["a", "aaaa", "aab", "abab", "日本", "日本日本語", "été", "𝒳𝒳y", "token", "tokens"])], "token string, blocks array<long>")
    runs = ["a", "aa", "aaa", "aaaa", "ab", "b", "bab", "日", "本日", "é", "été", "𝒳", "𝒳y", "ken", "oken", "tokens", "x"]
    for most in (1, 2, 4, 10**6):
        assert search.words_with(search.index_stretches(words), runs, most) == search.words_with(search.index_grams(words), runs, most)


def test_ranges_are_cut_at_the_widest_gaps():
    assert search._close([1, 2, 3, 9, 50, 51, 80], 3) == [(1, 9), (50, 51), (80, 80)] and search._close([], 3) == [] and search._close([4], 1) == [(4, 4)]
    assert search._close([5, 1, 3], 9) == [(1, 1), (3, 3), (5, 5)]


def test_empty_table(spark, table, tmp_path):
    search.build_index(table.limit(0), str(tmp_path / "i"), 50)
    assert search.search_index(spark, str(tmp_path / "i"), "word").count() == 0


def test_words_go_with_their_blocks_in_one_shuffle(spark):
    """A row for each pair of a word and a block went through two shuffles before."""
    table = spark.range(200).select(F.col("id").alias("row_id"), F.lit("some words").alias("text"))
    found = search.index_rows(table.coalesce(1), 10)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r["token"], r["part"], r["blocks"]) for r in found.collect()) == [("some", 0, list(range(20))), ("words", 0, list(range(20)))]


@pytest.mark.parametrize("query", ["m²", "a½b", "½", "ét", "12①", "名 前", "ⅷ", "x‍y"])
def test_characters_that_are_no_part_of_words(spark, tmp_path, query):
    """A search cuts its terms as the index cuts the texts, also at figures that Python counts to words."""
    texts = ["12 m² here", "a½b", "½ and 12①", "été", "名“前”", "chapter Ⅷ", "x‍y", "m 2", ""]
    table = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    search.build_index(table, str(tmp_path / "i"), 1)
    want = sorted(r["row_id"] for r in search.search(table, query, ["text"]).collect())
    assert sorted(r["row_id"] for r in search.search_index(spark, str(tmp_path / "i"), query).collect()) == want


@pytest.mark.parametrize("pairs", [1, 20, 10**6])
def test_words_of_rows_in_any_order(monkeypatch, pairs):
    """Whatever a task holds at once and wherever batches end, each word has each block once, in order, and one first part."""
    monkeypatch.setattr(search, "PAIRS", pairs)
    monkeypatch.setattr(search, "PART", 4)
    rng = random.Random(pairs)
    rows = [(rng.randrange(14), " ".join(rng.choice(["a", "b_1", "Été", "naïve—so", "日本", "c\x00d", "x"]) for _ in range(rng.randint(0, 5))).encode() + rng.choice([b"", b" \xff\xfez"])) for _ in range(80)]
    batches = [pa.RecordBatch.from_pylist([{"block": b, "text": t} for b, t in rows[k : k + 7]]) for k in range(0, 80, 7)]
    cut = [r for batch in search._cut(search.runs_pattern())(iter(batches)) for r in batch.to_pylist()]
    cut.sort(key=lambda r: (r["token"], r["part"]))
    schema = pa.schema({"token": pa.string(), "part": pa.int64(), "blocks": pa.list_(pa.int64())})
    merged = [r for batch in search._merged(iter([pa.RecordBatch.from_pylist(cut[k : k + 3], schema) for k in range(0, len(cut), 3)])) for r in batch.to_pylist()]
    want = {}
    for block, text in rows:
        for token in re.findall(r"\w+", text.decode("utf-8", "replace")):
            want.setdefault((token, block // 4), set()).add(block)
    assert [((r["token"], r["part"]), r["blocks"]) for r in merged] == [(k, sorted(want[k])) for k in sorted(want)]
    assert [r["first"] for r in merged] == [k == 0 or r["token"] != merged[k - 1]["token"] for k, r in enumerate(merged)]
