import corpus_pipeline
import public_tokenizers as P
import tiktoken

from __spark_entry__ import queries
from loomsheet.llm import bpe, quality, secrets, tiling
from loomsheet.llm.common import table, written


def test_stages_follow_from_their_operators(spark, sf):
    docs = table(spark, sf, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf))
        seen[name] = before, docs
        if name != "encode":
            assert docs.columns == before.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = seen["quality"]
    scored = quality.score(before, quality.train(before, table(spark, sf, "labels")))
    assert ids(after) == ids(scored.where("predicted = 1"))

    from tests.llm.test_jaccard import brute

    before, after = seen["near_duplicates"]
    groups = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert ids(after) == {i for i, (_, c) in groups.items() if i == c}

    before, after = seen["decontamination"]
    assert ids(after) == ids(before) - ids(tiling.leaks(before, table(spark, sf, "benchmark")))

    before, after = seen["secrets"]
    assert ids(after) == ids(before) and secrets.find(after).where("size(base) > 0").count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    clean = ids(secrets.find(before).where("size(spans) = 0"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in after.collect() if r["doc_id"] in clean)

    before, after = seen["encode"]
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
    want = {r["doc_id"]: encoding.encode_ordinary(r["text"]) for r in before.collect()}
    assert {r["doc_id"]: r["ids"] for r in after.collect()} == want


def test_it_is_registered():
    assert queries()["pipeline"] is corpus_pipeline.run


def test_odd_rows_pass_all_stages(spark, sf):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "lonely", None, None, None), (3, "a b c d e f token=abcdefgh1", "en", "s", 3), (3, "a b c d e f token=abcdefgh1", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert model.weights is not None and quality.keep_good(docs, model).columns == docs.columns
    # A fitted model, on rows with nulls, repeats and no rows at all: what it keeps is what it scores.
    scored = {(r["doc_id"], r["predicted"]) for r in quality.score(docs, model).collect()}
    kept = [r["doc_id"] for r in quality.keep_good(docs, model).collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in docs.collect() if (r["doc_id"], 1) in scored)
    assert quality.keep_good(docs.where("false"), model).count() == 0
    # The stage learns from its own input; of repeated rows one stays.
    own = quality.train(docs, table(spark, sf, "labels"))
    want = sorted({r["doc_id"] or 0 for r in quality.keep_good(docs, own).collect()})
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == want and len(want) > 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0
