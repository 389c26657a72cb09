import zlib

from loomsheet.llm import quality
from loomsheet.llm.common import labelled_sample
from loomsheet.llm.queries_quality import op10_quality

MEDIUM = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [r for r in op10_quality(spark, MEDIUM).collect() if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    good = [p for p, y in held if y == 1]
    assert sum(good) / len(good) > 0.98


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, ("the cat sat on a mat " if i % 2 else "!!! ### $$$ ") * 20, 1) for i in range(40)] + [(100, None, 2), (101, "", 3), (101, "", 3), (None, "é" * 9000, 4)], "doc_id long, text string, score int")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 44 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (100, 101)}) == 1
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i in range(40) if i % 2}
    assert quality.score(docs.where("false"), model).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(docs, model).collect()] == [0.5] and quality.keep_good(docs, model).count() == 1


def test_repeated_ids_bring_one_text_each(spark):
    """A labelled id that very many rows share brings one text to the driver, whatever the partitioning."""
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5][:20]
    rows = [(i, f"text {i}") for i in ids[1:]] + [(ids[0], f"text {k}") for k in range(500)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] * 3, "doc_id long, quality int")
    found = [labelled_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, "quality", 100) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0][0]) == len(ids) and found[0][1] == {0: 10, 1: 10}


def test_scores_are_calibrated(spark):
    """On held-out labels the mean score is about the share of good ones, which isn't that of the sample's even classes."""
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    share = sum(r["quality"] for r in rows) / len(rows)
    assert abs(sum(r["score"] for r in rows) / len(rows) - share) < 0.05
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        held = [r for r in rows if low <= r["score"] < high]
        if len(held) >= 30:
            assert abs(sum(r["score"] for r in held) / len(held) - sum(r["quality"] for r in held) / len(held)) < 0.2
