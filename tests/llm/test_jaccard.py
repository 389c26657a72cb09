import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from loomsheet.llm import jaccard
from loomsheet.llm.graph import components
from loomsheet.llm.queries_jaccard import op4_jaccard


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders, common = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for k in s:
            common.update((j, i) for j in holders[k])
            holders[k].append(i)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.fixture(scope="module")
def groups():
    """Groups of near copies with one to six edits, a passage that all share, exact copies and odd texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \t", "one", "ONE", "two words", "two\x0bwords", "é É", "x" * 20_000]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(40, 160))]
        for k in range(25):
            w = list(base)
            for _ in range(k % 7):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 40))]) for _ in range(60)]
    texts += [texts[10]] * 30
    order = list(enumerate(texts))
    rng.shuffle(order)
    return [(i, t) for i, (_, t) in enumerate(order)]


@pytest.mark.parametrize(("n", "percent", "parts", "held"), [(3, 90, 1, 1000), (3, 90, 5, 2), (5, 80, 3, 1000), (5, 80, 3, 3)])
def test_components_equal_brute_force(spark, groups, n, percent, parts, held, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", held)  # a small one splits shingles by the second order
    docs = spark.createDataFrame([(i, t, 0) for i, t in groups], "doc_id long, text string, node int").repartition(parts)
    assert result(jaccard.join(docs, n, percent)) == brute(groups, n, percent)


def test_crowded_shingles_make_few_pairs(spark, monkeypatch):
    """Texts of one passage and a few own words, each too far from the others to link; some texts of it that do link."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(98)]
    texts = [" ".join(passage + [word() for _ in range(7)]) for _ in range(1_200)]
    for at in range(40):  # half of the passage, with one or two words changed: similar to some of their kind
        texts.append(" ".join([*passage[:50], *[word() for _ in range(40)]][: 90 - at % 3]))
        texts.append(texts[-1] + " " + word())
    met = []

    class Counted(jaccard.Tables):
        def __call__(self, df, name):
            out = super().__call__(df, name)
            if name == "keyed":
                sides = out.groupBy("key").agg(F.count_if("low").alias("lows"), F.count_if("high").alias("highs"))
                met.append(sides.agg(F.sum(F.col("lows") * F.col("highs"))).first()[0] or 0)
            return out

    monkeypatch.setattr(jaccard, "HELD", 50)
    monkeypatch.setattr(jaccard, "Tables", Counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert result(jaccard.join(docs, 3, 90)) == brute(list(enumerate(texts)), 3, 90)
    assert len(met) == 1 and met[0] < 50 * len(texts)  # all pairs of one shingle would be 720,000


@pytest.mark.parametrize("small", [False, True])
def test_links_are_counted_exactly(spark, groups, small, monkeypatch):
    if small:
        for name, value in (("PAIRED", 4), ("WIDE", 16), ("HELD", 3)):
            monkeypatch.setattr(jaccard, name, value)
    sets = {}
    for i, t in groups:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(zip(*[w[k:] for k in range(3)])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    near = lambda a, b: 100 * len(a & b) >= 90 * len(a | b)
    of_set = {s: sum(near(s, o) for o in set(sets.values()) if o and o != s) for s in set(sets.values())}
    docs = spark.createDataFrame(groups, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.join(docs, 3, 90, count_links=True).collect()}
    assert got == {i: of_set[s] if s else 0 for i, s in sets.items()} and max(got.values()) > 3


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(op4_jaccard(spark, sf)) == brute(rows, 3, 90)


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g", 1), (1, "a b c d e f g", 2), (2, "other words are here now", 3), (2, "other words are here now", 3), (None, "a b c d e f g", 4), (9, None, 5)], "doc_id long, text string, label int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["label"]) for r in kept.collect()) == [(0, 4), (1, 2), (2, 3), (9, 5)]


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    labels = {r["v"]: r["label"] for r in components(links).collect()}
    assert labels == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500}
