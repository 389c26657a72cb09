"""The Merkle manifest against trees built one node at a time."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loomsheet.llm import merkle
from loomsheet.llm.common import Tables
from loomsheet.llm.queries_merkle import op12_merkle
from loomsheet.sources.shared import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf int, pos int"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and for each node the siblings on its way up, as (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 8
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def plain(rows):
    """Rows of doc_id, text, lang, source, n_chars."""
    langs = {}
    for doc_id, text, lang, source, n_chars in rows:
        langs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), doc_id, text, source, n_chars))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    made = {lang: (sorted(langs[lang], key=lambda r: r[:3]), *tree([r[2] for r in sorted(langs[lang], key=lambda r: r[:3])])) for lang in order}
    root, upper = tree([made[lang][1] for lang in order])
    out = []
    for lang, more in zip(order, upper, strict=True):
        held, subroot, paths = made[lang]
        for (_, _, own, doc_id, text, source, n_chars), path in zip(held, paths, strict=True):
            f = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                f = leaf(doc_id, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            for a, b in path + more:
                f = h(a + f + b)
            out.append((doc_id, own, subroot, root, h("".join(a + b for a, b in path + more)), f, f == root))
    return sorted(out, key=str)


def run(spark, rows):
    """op12 over a made-up table with extra columns of clashing names."""
    folder = scratch(spark, "docs")
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in op12_merkle(spark, folder).collect()), key=str)


def test_query_against_plain_trees(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in op12_merkle(spark, sf).collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    """Nulls in each column, repeated rows and ids, negative and far ids, single leaves, many levels."""
    rows = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (None, "b", "en", None, None), (None, None, None, None, None), (-5, "Neg", "en", "s", 3), (-(2**62), "Far", "en", "s", 3), (2**62, "", "en", "s", 0)]
    rows += [(k, f"Text {k}", "en", "s", k) for k in range(150)] + [(7, "Other", "en", "t", 5), (7, "Text 7", "en", "s", 7), (7, "Text 7", "en", "s", 7)]
    rows += [(k * 5000, "Ü" * k, "de", "s", k) for k in range(70)] + [(1, "only", "zz", "s", 4), (2, "X" * 20_000, None, "s", 20_000)] + [(k, "same", f"l{k}", "s", 4) for k in range(9)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_sizes_around_a_run(spark, n):
    rows = [(k, f"T{k}", "en", "s", 1) for k in range(n)]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_places_by_rank(spark, monkeypatch):
    """Dense and sparse chunks, repeats, and equal rows that are spread over several rows."""
    monkeypatch.setattr(merkle, "TOGETHER", 10)
    ids = [*range(3_000), *range(4_096, 4_096 + 128), *range(9_000, 400_000, 997), *[5] * 35, *[4_100] * 3, -1, -4_096, -4_097]
    keep = Tables(spark)
    rows = keep(spark.createDataFrame([("." + "ab"[i % 2], i) for i in ids], "tree string, doc_id long").withColumn("leaf", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)).repartition(4), "rows")
    placed = merkle.coordinates(rows, keep).collect()
    for t in (0, 1):
        own = sorted((r["pos"], r["doc_id"], r["n"]) for r in placed if r["tree"] == "." + "ab"[t])
        want = sorted(i for i in ids if i % 2 == t)
        assert own == [(k, i, len(want)) for k, i in enumerate(want)]
