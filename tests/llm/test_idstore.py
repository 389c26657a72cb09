"""Token-id output against the library's own ids of whole texts, and against a scan of the files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomsheet.llm import idstore
from loomsheet.llm.queries_idstore import TOKENIZER, op11_id_store
from loomsheet.llm.tokens import Encoder
from loomsheet.sources.shared import scratch

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def plain(own, docs):
    """(doc_id, start, n, crc) of documents in their order, by the library alone."""
    out, at = [], 0
    for doc_id, text in docs:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_query_against_the_library(spark, sf, own):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda r: r[0])
    assert got(op11_id_store(spark, sf)) == plain(own, docs)


def test_pieces_give_the_ids_of_whole_texts(own):
    rng = random.Random(5)
    chars = " \n\t.,;:!?'sta1éB漢$#　\x1f\x0b\x85"
    texts = ["".join(rng.choice(chars[: rng.choice([8, 17, len(chars)])]) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    texts += ["", " ", "\n", "a b" * 50_000, "<|endoftext|>. a <|endoftext|> b", "don't stop.\nNow, it's 5.\n\nEnd ", "x" * 100_000]
    found = Encoder(PATH).encode(pa.array(texts))
    assert all(np.array(own.encode(t, add_special_tokens=False).ids, "<u2").tobytes() == x for t, x in zip(texts, found, strict=True))


def test_forgetting_pieces_changes_no_ids(own, monkeypatch):
    monkeypatch.setattr("loomsheet.llm.tokens.KEPT", 50)
    rng, short = random.Random(6), Encoder(PATH)
    for _ in range(5):
        texts = [" ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(40)) for _ in range(20)]
        assert [np.frombuffer(x, "<u2").tolist() for x in short.encode(pa.array(texts))] == [own.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(short.words) <= 50


def test_perfect_hash_has_no_gaps_and_knows_strangers():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 63, 5_000):
        doc_id = rng.permutation(10 * n + 1)[:n].astype(np.int64) - 3 * n
        copy = rng.integers(-2, 3, n)
        own = idstore.PerfectHash.build(doc_id, copy)
        again, _ = idstore.PerfectHash.load(memoryview(own.dump()), len(own.sizes), len(own.rest))
        assert sorted(again.slots(doc_id, copy).tolist()) == list(range(n))
    assert (own.slots(np.arange(1, 1000) * 10**9, np.zeros(999, np.int64)) >= -1).all()


def test_keys_that_meet_on_every_level_are_kept_apart(monkeypatch):
    monkeypatch.setattr(idstore, "_folded", lambda doc_id, copy: np.zeros(len(doc_id), np.uint64))
    doc_id, copy = np.arange(5), np.zeros(5, np.int64)
    own = idstore.PerfectHash.build(doc_id, copy)
    assert len(own.rest) == 5 and sorted(own.slots(doc_id, copy).tolist()) == list(range(5))
    assert own.slots(np.array([77]), np.array([0])).tolist() == [-1]


@pytest.mark.parametrize("shard_bytes", [16, 1 << 20])
def test_odd_rows(spark, own, shard_bytes):
    """Null and repeated ids, null, empty and long texts, clashing columns; shards of one document and of all."""
    rows = [(None, "nothing", 1), (None, None, 2), (3, "b c", 3), (-7, "", 4), (3, "b c", 5), (3, "other", 6), (10, "long text " * 5_000, 7), (2**40, None, 8)]
    rows += [(5, f"copy {k % 3}", k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy int").repartition(5)
    path = scratch(spark, "ids")
    idstore.write(docs, path, PATH, shard_bytes=shard_bytes)
    cut = idstore.read(spark, idstore.lookup(idstore.keys(spark, path), path), path, idstore.lists, "array<int>").collect()
    assert len({(r["doc_id"], r["copy"]) for r in cut}) == len(cut) == len(rows)
    texts = {}
    for r in sorted(cut, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["copy"])):
        texts.setdefault(r["doc_id"], []).append(tuple(r["value"]))
    want = {}
    for doc_id, text, _ in rows:
        want.setdefault(doc_id, []).append((*own.encode(text or "", add_special_tokens=False).ids, 2))
    assert {k: sorted(v) for k, v in texts.items()} == {k: sorted(v) for k, v in want.items()}
    ordered = sorted(cut, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1].tolist()]
    held = idstore.Reader(spark, path)
    for r in ordered[::40]:
        assert held.get(r["doc_id"], r["copy"]).tolist() == r["value"]
    assert all(held.get(k) is None for k in (4, -8, 10**15)) and held.get(5, 300) is None


def test_strangers_are_not_found(spark, sf):
    path = scratch(spark, "ids")
    idstore.write(spark.read.parquet(f"{sf}/documents.parquet"), path, PATH)
    strangers = spark.range(10**7, 10**7 + 5_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy"))
    assert idstore.lookup(strangers, path).count() == 0


def test_empty_table(spark):
    path = scratch(spark, "ids")
    idstore.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert idstore.read(spark, idstore.lookup(idstore.keys(spark, path), path), path, idstore.crcs, "long").collect() == []
    assert idstore.Reader(spark, path).get(1) is None
