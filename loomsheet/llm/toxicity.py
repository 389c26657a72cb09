"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the vector of the word, if the training texts had it often enough, joined to the
mean of the vectors of its characters' trigrams and first letters. Windows of ``WINDOW`` words, each
``STRIDE`` after the last, run over the whole text, so that windows overlap. Two gated recurrent
layers read a window from either end; attention weighs their states; a logit says how toxic the
window is. A document's score comes from its most toxic window and the number of its windows, by a
logistic fit.

Only documents are labelled. A first guess of the windows that made a document toxic comes from the
odds of words and beginnings of words; after training, the network itself picks them, and trains
once more, with the clean windows that it found most toxic.

Defined results: null and empty texts have no window and get the score of a text with the mildest
window; without labels of both classes every score is 0.5; repeated rows repeat their score; extra
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import bounded, held_out, labelled_sample, slices, text_of, utf8

WINDOW, STRIDE = 24, 16
WORD, CHAR, HIDDEN = 8, 8, 8
GRAMS = 8192  # rows of the table of character n-grams
SEEN = 4  # times that a word must occur in the training texts to have a vector
SAMPLE = 3000  # labelled texts to learn from, at most
BATCH, STEPS = 256, 120  # windows of a step; steps of each of the two turns, at least
BLOCK = 1_000_000
MILDEST = -12.0

_BARE = np.arange(256, dtype=np.uint8)
_BARE[[c for c in range(128) if not chr(c).isalnum()]] = 32
_BARE[65:91] += 32


@dataclass
class Block:
    """The words of a block of texts: token -> word, and each different word's hash and n-grams."""

    tokens: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    heads: np.ndarray


def read(column: pa.Array) -> Block:
    raw, offsets = utf8(column)
    raw = _BARE[raw]
    every, ends = sh.words(raw, offsets, lower=False)
    hashes, first, tokens = np.unique(every, return_index=True, return_inverse=True)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return Block(none, ends, hashes, none, none, none)
    solid = raw != 32
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    begins[inner] = solid[inner]
    starts = np.flatnonzero(begins)
    # A word ends before the next blank or the next word.
    stops = np.flatnonzero(np.append(~solid, True) | np.append(begins, False))
    lengths = stops[np.searchsorted(stops, starts, side="right")] - starts
    starts, lengths = starts[first], lengths[first]
    # The different words one after the other, each between a 1 and a 2.
    wide = lengths + 2
    heads = np.cumsum(wide) - wide
    held = np.full(int(wide.sum()), 2, np.uint8)
    held[heads] = 1
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held[np.repeat(heads + 1, lengths) + place] = raw[np.repeat(starts, lengths) + place]
    long = held.astype(np.uint64)
    three = long[:-2] * np.uint64(65536) + long[1:-1] * np.uint64(256) + long[2:]
    keep = np.repeat(heads, lengths) + place
    grams = (sh.mix(three[keep]) % np.uint64(GRAMS)).astype(np.int64)
    five = np.zeros(len(heads), np.uint64)
    for k in range(5):
        inside = k < wide
        five[inside] = five[inside] * np.uint64(256) + long[heads[inside] + k]
    beginnings = (sh.mix(five + np.uint64(7)) % np.uint64(GRAMS)).astype(np.int64)
    return Block(tokens, ends, hashes, grams, np.cumsum(lengths) - lengths, beginnings)


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window its first token and the end of its text, and where each text's windows begin."""
    sizes = np.diff(ends)
    many = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    bounds = np.append(0, np.cumsum(many))
    k = np.arange(bounds[-1]) - np.repeat(bounds[:-1], many)
    return np.repeat(ends[:-1], many) + k * STRIDE, np.repeat(ends[1:], many), bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name; known: the hashes of words that have a vector, ascending."""

    known: np.ndarray
    w: dict[str, np.ndarray] = field(default_factory=dict)
    fit: np.ndarray | None = None  # of the document's score: constant, window's logit, log of windows

    @staticmethod
    def fresh(known: np.ndarray, seed: int = 1) -> Network:
        g, size = np.random.default_rng(seed), WORD + CHAR
        draw = lambda *shape, by=0.3: (g.standard_normal(shape) * by).astype(np.float32)
        w = {"words": draw(len(known) + 2, WORD, by=0.1), "grams": draw(GRAMS, CHAR, by=0.1), "begins": draw(GRAMS, CHAR, by=0.1)}
        for d in ("f", "b"):
            w |= {f"x{d}": draw(size, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"attend": draw(2 * HIDDEN, by=0.5), "out": draw(2 * HIDDEN, by=0.5), "bias": np.zeros(1, np.float32)}
        return Network(known, w)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word's vector: 0 for nothing, 1 for an unknown word."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at + 2, 1) if len(self.known) else np.ones(len(hashes), np.int64)

    def inputs(self, rows: np.ndarray, block: Block, ids: np.ndarray | None = None) -> np.ndarray:
        """The input vectors of the block's different words, or of those with ``ids``; the last is nothing's."""
        grams = np.add.reduceat(self.w["grams"][block.grams], block.gram_starts, axis=0) if len(block.grams) else np.zeros((0, CHAR), np.float32)
        counts = np.diff(np.append(block.gram_starts, len(block.grams)))[:, None]
        chars = 0.5 * grams / np.maximum(counts, 1) + 0.5 * self.w["begins"][block.heads]
        x = np.concatenate([self.w["words"][rows], chars.astype(np.float32)], axis=1)
        return np.concatenate([x, np.concatenate([self.w["words"][:1], np.zeros((1, CHAR), np.float32)], axis=1)])

    def layer(self, gates: np.ndarray, d: str, keep: bool = False):
        """The states (steps first) for gates of (step, window, 3 x HIDDEN); also what going back needs."""
        steps, n, _ = gates.shape
        h, u = np.zeros((n, HIDDEN), np.float32), self.w[f"u{d}"]
        out, saved = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = h @ u
            zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gates[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep:
                saved.append((t, h, z, r, c, a[:, 2 * HIDDEN :]))
            h = h + z * (c - h)
            out[t] = h
        return out, saved

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """The logit of each window; ``index`` (step, window) points into ``x``, whose last row is nothing."""
        sides, saved = [], []
        for d in ("f", "b"):
            gates = (x @ self.w[f"x{d}"] + self.w[f"c{d}"])[index]
            states, s = self.layer(gates, d, keep)
            sides.append(states)
            saved.append(s)
        states = np.concatenate(sides, axis=2)
        weigh = np.where(index == len(x) - 1, np.float32(-1e9), states @ self.w["attend"])
        weigh = np.exp(weigh - weigh.max(axis=0))
        weigh /= weigh.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weigh, states)
        return pooled @ self.w["out"] + self.w["bias"][0], (states, weigh, pooled, saved)

    def gradients(self, x: np.ndarray, index: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean logistic loss: by the weights above the inputs, and by ``x``."""
        logits, (states, weigh, pooled, saved) = self.forward(x, index, keep=True)
        g: dict[str, np.ndarray] = {}
        d_logit = ((_sigmoid(logits) - y) / len(y)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.w["out"]
        d_weigh = np.einsum("nh,tnh->tn", d_pooled, states)
        d_raw = weigh * (d_weigh - (weigh * d_weigh).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_raw, states)
        d_states = weigh[:, :, None] * d_pooled + d_raw[:, :, None] * self.w["attend"]
        d_x = np.zeros_like(x)
        for k, d in enumerate(("f", "b")):
            u, d_h = self.w[f"u{d}"], 0.0
            d_u, d_gates = np.zeros_like(u), np.empty((*index.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, c, a in reversed(saved[k]):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                d_c = d_h * z * (1 - c * c)
                d_z = d_h * (c - h) * z * (1 - z)
                d_r = d_c * a * r * (1 - r)
                d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_a = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_u += h.T @ d_a
                d_h = d_h * (1 - z) + d_a @ u.T
            by_input = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(by_input, index.ravel(), d_gates.reshape(-1, 3 * HIDDEN))
            g[f"u{d}"], g[f"x{d}"], g[f"c{d}"] = d_u, x.T @ by_input, by_input.sum(axis=0)
            d_x += by_input @ self.w[f"x{d}"].T
        return g, d_x

    def logits(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of a block, and where each text's windows begin."""
        starts, stops, bounds = windows(block.ends)
        if not len(starts):
            return np.zeros(0, np.float32), bounds
        x = self.inputs(self.rows(block.hashes), block)
        padded = np.append(block.tokens, np.zeros(WINDOW, np.int64))
        out = np.empty(len(starts), np.float32)
        for k in range(0, len(starts), 2048):
            at = starts[k : k + 2048] + np.arange(WINDOW)[:, None]
            index = np.where(at < stops[k : k + 2048], padded[np.minimum(at, len(padded) - 1)], len(x) - 1)
            out[k : k + 2048] = self.forward(x, index)[0]
        return out, bounds

    def scores(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's score, its most toxic window's logit and the number of its windows."""
        logits, bounds = self.logits(block)
        many = np.diff(bounds)
        most = np.full(len(many), MILDEST)
        if len(logits):
            some = many > 0
            most[some] = np.maximum.reduceat(logits, bounds[:-1][some])
        return self.document(most, many), most, many

    def document(self, most: np.ndarray, many: np.ndarray) -> np.ndarray:
        if self.fit is None:
            return np.full(len(most), 0.5)
        return _sigmoid(np.clip(_features(most, many) @ self.fit, -30, 30))


def _features(most: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(most)), np.clip(most, MILDEST, -MILDEST), np.log1p(many)])


class Adam:
    def __init__(self, rate: float):
        self.rate, self.first, self.second, self.t = rate, {}, {}, 0

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, v in g.items():
            m = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * v
            s = self.second[k] = 0.99 * self.second.get(k, 0) + 0.01 * v * v
            w[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


def _first_guess(block: Block, labels: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """How toxic each different word looks from the odds of it and of its beginning in toxic documents."""
    odds = np.full(len(block.hashes), -9.0)
    for keys in (np.arange(len(block.hashes)), block.heads):
        pairs = np.unique(keys[block.tokens] * np.int64(len(labels)) + doc_of)
        toxic = labels[pairs % len(labels)] == 1
        size = int(keys.max()) + 1
        bad = np.bincount(pairs[toxic] // len(labels), minlength=size)
        good = np.bincount(pairs[~toxic] // len(labels), minlength=size)
        odds = np.maximum(odds, (np.log((bad + 0.2) / (good + 0.2)) - 0.5 / (bad + good + 0.1) ** 0.5)[keys])
    return odds


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, epochs: int = 4, seed: int = 3) -> Network:
    """Learns from ``most`` labelled texts at most."""
    return train_on([(t, y) for t, y in labelled_sample(docs, labels, label, most)[0] if t.strip()], epochs, seed)


def train_on(sample: list[tuple[str, int]], epochs: int = 4, seed: int = 3) -> Network:
    y = np.array([v for _, v in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return Network.fresh(np.zeros(0, np.uint64))
    rng = np.random.default_rng(seed)
    block = read(pa.array([t for t, _ in sample], pa.string()))
    sizes = np.diff(block.ends)
    doc_of = np.repeat(np.arange(len(y)), sizes)
    counts = np.bincount(block.tokens, minlength=len(block.hashes))
    net = Network.fresh(block.hashes[counts >= SEEN])
    rows = net.rows(block.hashes)
    starts, stops, bounds = windows(block.ends)
    at = starts + np.arange(WINDOW)[:, None]
    nothing = len(block.hashes)
    index = np.where(at < stops, np.append(block.tokens, np.zeros(WINDOW, np.int64))[np.minimum(at, len(block.tokens) + WINDOW - 1)], nothing)
    guess = np.append(_first_guess(block, y, doc_of), -9.0)[index].max(axis=0)
    window_doc = np.repeat(np.arange(len(y)), np.diff(bounds))
    adam = Adam(0.01)
    for _ in range(2):
        # The most toxic window of each toxic document, and clean ones: the hardest and others at random.
        order = np.lexsort((-guess, window_doc))
        top = order[np.append(True, window_doc[order][1:] != window_doc[order][:-1])]
        bad = top[y[window_doc[top]] == 1]
        clean = np.flatnonzero(y[window_doc] == 0)
        hard = clean[np.argsort(-guess[clean], kind="stable")[: len(bad)]]
        size = 3 * len(bad) + min(len(clean), 6 * len(bad))
        for _ in range(max(epochs, -(-STEPS * BATCH // size))):
            picked = np.concatenate([bad, bad, hard, rng.choice(clean, min(len(clean), 6 * len(bad)), replace=False)])
            rng.shuffle(picked)
            for k in range(0, len(picked), BATCH):
                some = picked[k : k + BATCH]
                _step(net, adam, block, rows, index[:, some], (y[window_doc[some]] == 1).astype(np.float32), rng)
        guess, _ = net.logits(block)
    best = np.maximum.reduceat(guess, bounds[:-1][np.diff(bounds) > 0])
    some = np.diff(bounds) > 0
    x, v = _features(best, np.diff(bounds)[some]), y[some].astype(float)
    w, weight = np.zeros(3), np.where(v == 1, 0.5 / max(v.sum(), 1), 0.5 / max((1 - v).sum(), 1)) * len(v)
    for _ in range(60):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        w += np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.5 * np.eye(3), x.T @ (weight * (v - p)) - 0.5 * w)
    net.fit = w
    return net


def _step(net: Network, adam: Adam, block: Block, rows: np.ndarray, index: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
    """One step on a batch of windows; a third of the words lose their own vector, so that their characters learn too."""
    nothing = len(block.hashes)
    words, index = np.unique(index, return_inverse=True)
    if words[-1] != nothing:
        words = np.append(words, nothing)
    words, index = words[:-1], index.reshape(WINDOW, -1)
    begin = block.gram_starts[words]
    end = np.append(block.gram_starts, len(block.grams))[words + 1]
    lengths = end - begin
    grams = block.grams[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
    part = Block(np.zeros(0, np.int64), block.ends, block.hashes[words], grams, np.cumsum(lengths) - lengths, block.heads[words])
    own = np.where(rng.random(len(words)) < 0.33, 1, rows[words])
    x = net.inputs(own, part)
    g, d_x = net.gradients(x, index, y)
    for name, shape in (("words", net.w["words"]), ("grams", net.w["grams"]), ("begins", net.w["begins"])):
        g[name] = np.zeros_like(shape)
    np.add.at(g["words"], np.append(own, 0), d_x[:, :WORD])
    d_chars = 0.5 * d_x[:-1, WORD:]
    np.add.at(g["begins"], part.heads, d_chars)
    np.add.at(g["grams"], grams, np.repeat(d_chars / np.maximum(lengths, 1)[:, None], lengths, axis=0))
    adam.step(net.w, g)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows, most (the most toxic window's logit), for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # its size depends on the sample's bound only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                p, most, many = own.scores(read(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array(many.astype(np.int64)), pa.array(most)], ["doc_id", "held_out", "score", "n_windows", "most"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    scored = bounded(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, n_windows long, most double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
