import zlib

import numpy as np
import pyarrow as pa

from loomsheet.llm import toxicity as tox
from loomsheet.llm.queries_toxicity import op9_toxicity

MEDIUM = "/root/testdata/sf0.1"


def test_blocks_of_words():
    block = tox.read(pa.array(["Bad, bad day", "", "day?é  x", "tail"]))
    assert np.diff(block.ends).tolist() == [3, 0, 3, 1] and len(block.hashes) == 5
    assert block.tokens[0] == block.tokens[1] and block.tokens[2] == block.tokens[3]
    counts = np.diff(np.append(block.gram_starts, len(block.grams)))
    assert sorted(counts.tolist()) == [1, 2, 3, 3, 4]
    assert len(tox.read(pa.array(["", " "])).tokens) == 0


def test_windows_cover_every_word_and_overlap():
    for n in (1, 5, 24, 25, 40, 41, 1000):
        starts, stops, bounds = tox.windows(np.array([0, n, n]))
        assert bounds.tolist() == [0, len(starts), len(starts)] and set(np.diff(starts)) <= {tox.STRIDE}
        assert starts[-1] + tox.WINDOW >= n and (len(starts) == 1 or starts[-2] + tox.WINDOW < n)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = tox.Network.fresh(np.zeros(0, np.uint64))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.standard_normal((7, tox.WORD + tox.CHAR))
    index, y = rng.integers(0, 7, (tox.WINDOW, 5)), np.array([0, 1, 1, 0, 1.0])
    index[:3] = 1

    def loss():
        z = net.forward(x, index)[0].astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    net.layer = lambda gates, d, keep=False: _double_layer(net, gates, d, keep)
    g, d_x = net.gradients(x, index, y)
    for name in ("uf", "ub", "xf", "xb", "cf", "cb", "attend", "out"):
        flat = net.w[name].reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - g[name].reshape(-1)[k]) < 1e-4, name
    old = x[2, 3]
    x[2, 3] = old + 1e-5
    up = loss()
    x[2, 3] = old - 1e-5
    down = loss()
    assert abs((up - down) / 2e-5 - d_x[2, 3]) < 1e-4


def _double_layer(net, gates, d, keep):
    h, u, out, saved = np.zeros((gates.shape[1], tox.HIDDEN)), net.w[f"u{d}"], np.empty((*gates.shape[:2], tox.HIDDEN)), []
    for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
        a = h @ u
        zr = tox._sigmoid(gates[t, :, : 2 * tox.HIDDEN] + a[:, : 2 * tox.HIDDEN])
        z, r = zr[:, : tox.HIDDEN], zr[:, tox.HIDDEN :]
        c = np.tanh(gates[t, :, 2 * tox.HIDDEN :] + r * a[:, 2 * tox.HIDDEN :])
        saved.append((t, h, z, r, c, a[:, 2 * tox.HIDDEN :]))
        h = h + z * (c - h)
        out[t] = h
    return out, saved


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = op9_toxicity(spark, MEDIUM).collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p for p, y in held if y == 1]) >= 0.88
    assert np.mean([p for p, y in held if y == 0]) < 0.02


def test_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"calm words {i} here " + ("you idiot" if i % 2 else "you friend") + " and more", 0) for i in range(60)] + [(100, None, 0), (101, "", 0), (101, "", 0), (None, "idiot " * 20_000, 0), (102, "x" * 50_000, 0)], "doc_id long, text string, score int")
    net = tox.train(docs, labels)
    rows = tox.score(docs, net).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 65 and len({r["score"] for r in rows if r["doc_id"] in (100, 101)}) == 1 and scores[101] < 0.5
    assert sum((scores[i] >= 0.5) == (i % 2 == 1) for i in range(60)) == 60
    assert tox.score(docs.where("false"), net).count() == 0
    blank = tox.train(docs, labels.where("false"))
    assert {r["score"] for r in tox.score(docs, blank).collect()} == {0.5}
