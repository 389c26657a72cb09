import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from loomsheet.llm import bpe
from loomsheet.llm.queries_bpe import op6_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n\n  x", "don't 'Ll", "a" * 30_000, "é😀\u0000​漢字 ｆｕｌｌ", "1234567890" * 500, "\t tab\r\n", "<|endoftext|>", "word" * 3000 + " end", "▁ sentence▁piece"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("parts", [1, 4])
def test_ids_equal_the_rank_library_and_decode(spark, reference, parts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string").repartition(parts)
    for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect():
        text = ODD[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(text) and bytes(r["data"]) == text.encode()


def test_query(spark, sf, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_the_serialised_model_alone_merges_by_rank():
    codec = bpe.Codec(PATH, P.PATTERN)
    rng = np.random.default_rng(3)
    for token in [codec.tokens[k] for k in rng.integers(256, len(codec.tokens), 300)]:
        assert b"".join(codec.tokens[i - 1] for i in codec.model.encode(bpe.mapped(token))) == token


def test_bad_vocabulary():
    with pytest.raises(ValueError):
        bpe.model_proto({b"a": 0, b"b": 2})


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
