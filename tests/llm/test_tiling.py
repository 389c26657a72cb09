import random
import re
import time

import pyarrow as pa
import pytest

from loomsheet.llm import tiling
from loomsheet.llm.queries_tiling import op8_decontaminate


def split(text):
    return re.sub(r"[!-/:-@\[-`{-\x7f]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).split()


def brute(doc, item, n=tiling.SEED):
    """Greedy string tiling straight from its definition: the number of covered words of the item."""
    a, b = split(item), split(doc)
    n = min(n, len(a))
    if not n:
        return 0, 0
    marked_a, marked_b, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in marked_a and j + k not in marked_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < n:
            return covered, len(a)
        marked_a.update(range(i, i + k))
        marked_b.update(range(j, j + k))
        covered += k


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 30))
    items = [" ".join(word() for _ in range(rng.randint(20, 40))) for _ in range(8)] + ["", None, "one two", "Same words, again!"]
    docs = [None, "", "one two", "one x two", "same WORDS again", " ".join(word() for _ in range(100))]
    for item in items[:8]:
        w = item.split()
        docs += [item, " ".join(w[10:] + ["and"] + w[:10]), " ".join(w[: len(w) // 3]), "so: " + item.upper() + "."]
        docs.append(" ".join(w[:7] + ["x"] + w[7:14] + ["y"] + w[14:]))
    return docs, items


@pytest.mark.parametrize("parts", [1, 4])
def test_leaks_equal_brute_force(spark, cases, parts):
    docs, items = cases
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item_id int").repartition(parts)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in tiling.leaks(df, bench).collect()}
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            covered, size = brute(d, t)
            if size and covered >= tiling.COVERAGE * size:
                want[i, j] = covered
    assert got == want and len(want) > 30
    kept = tiling.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_blocks_and_a_full_bitmap_change_nothing(spark, cases, monkeypatch):
    docs, items = cases
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda: sorted(tuple(r) for r in tiling.leaks(df, bench).collect())
    whole = rows()
    for name, value in (("BITS", 2**15), ("SEEDS", 3), ("LISTED", 0)):
        monkeypatch.setattr(tiling, name, value)
    assert rows() == whole


def test_the_query_equals_brute_force_on_all_pairs_with_a_common_seed(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    grams = lambda t: {tuple(w[i : i + tiling.SEED]) for w in [split(t)] for i in range(len(w) - tiling.SEED + 1)}
    own, want = {i: grams(t) for i, t in items.items()}, {}
    for d, text in docs.items():
        have = grams(text)
        for i in items:
            if own[i] & have:
                covered, size = brute(text, items[i])
                if covered >= tiling.COVERAGE * size:
                    want[d, i] = covered
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] for r in op8_decontaminate(spark, sf).collect()}
    assert want and got == want


def test_repeated_words_take_seconds(spark):
    began = time.perf_counter()
    docs = spark.createDataFrame([(1, "same " * 20_000), (2, "same other " * 10_000), (3, "same " * 300_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "same " * 400), (8, "other same " * 200)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_tiles"], r["n_matched"]) for r in tiling.leaks(docs, bench).collect()}
    assert got == {(1, 7): (1, 400), (2, 8): (1, 400), (3, 7): (1, 400)} and time.perf_counter() - began < 90


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert tiling.leaks(docs, bench).count() == 0 and tiling.drop_leaks(docs, bench).count() == 0


def test_words_without_any():
    assert len(tiling.words(pa.array(["", "?!"]))[0]) == 0
