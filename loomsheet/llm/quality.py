"""Quality classifier by compression.

Zstandard dictionaries are trained on labelled text, one on good and one on bad texts, and two more on
the shapes of the same texts (letters folded to one of two marks, digits to one), where junk layout
shows whatever the words are. A text is compressed whole, in pieces of ``PIECE`` bytes, short enough
that the dictionaries rather than the text's own repetitions make them small, and its shape likewise.
With g and b the total sizes by the good and the bad dictionaries, the normalised difference
(b - g) / (b + g) is the only feature; a logistic fit on other labelled texts turns it into a
calibrated score. The sample has as many texts of each class where it can; the fit's intercept is
then moved by what the classes' shares of all labels differ from those of the sample.

Defined results: null and empty texts have the difference 0; without labels of both classes every
score is 0.5; repeated rows repeat their score; extra columns are dropped by ``score`` and kept by
``keep_good``. Classes with too little text to train on lend their text itself as the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, held_out, labelled_sample, slices, text_of

PIECE = 128
SAMPLE = 3000  # labelled texts to learn from, at most
DICTIONARY = 64 * 1024
LEVEL = 3
THRESHOLD = 0.3

_SHAPE = bytes(
    ord("a") if chr(b).islower() and b < 128 or b >= 128 else ord("A") if chr(b).isupper() and b < 128 else ord("0") if 48 <= b < 58 else b
    for b in range(256)
)


def shape(data: bytes) -> bytes:
    return data.translate(_SHAPE)


def pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on all pieces of the texts."""
    cut = [p for s in samples for p in pieces(s)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, cut)) // 8), cut, level=LEVEL)
    except zstandard.ZstdError:  # a few pieces are not enough to train on
        return zstandard.ZstdCompressionDict(b"".join(cut)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@dataclass
class Model:
    """Dictionaries (good, bad, good shapes, bad shapes) as bytes, whether each is trained, and the weights of the fit."""

    dictionaries: list[tuple[bytes, int]]
    weights: np.ndarray | None

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw, kind in self.dictionaries:
            held = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            held.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made

    def scores(self, differences: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(differences), 0.5)
        return 1 / (1 + np.exp(-np.clip(_scaled(differences) @ self.weights, -30, 30)))


def difference(data: bytes, compressors: list[zstandard.ZstdCompressor]) -> float:
    """The normalised difference of the compressed sizes of a text."""
    good = bad = 0
    good_words, bad_words, good_shapes, bad_shapes = compressors
    for piece in pieces(data):
        shaped = shape(piece)
        good += len(good_words.compress(piece)) + len(good_shapes.compress(shaped))
        bad += len(bad_words.compress(piece)) + len(bad_shapes.compress(shaped))
    return (bad - good) / (bad + good) if data else 0.0


def _scaled(differences: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(differences)), 50 * differences])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Model:
    """Learns from ``most`` labelled texts at most: one half of each class makes its dictionary, the other the fit."""
    sample, many = labelled_sample(docs, labels, label, most)
    rows = [(t.encode(), y) for t, y in sample if t]
    by = {y: [t for t, v in rows if v == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return Model([], None)
    texts = [[t if k == 0 else shape(t) for t in by[y][::2]] for k in (0, 1) for y in (1, 0)]
    made = Model([], None)
    for held in map(dictionary, texts):
        made.dictionaries.append((held.as_bytes(), zstandard.DICT_TYPE_AUTO if held.dict_id() else zstandard.DICT_TYPE_RAWCONTENT))
    c = made.compressors()
    fit = [(t, y) for y in (0, 1) for t in by[y][1::2] or by[y]]
    made.weights = _logistic(_scaled(np.array([difference(t, c) for t, _ in fit])), np.array([float(y) for _, y in fit]))
    share = sum(y for _, y in fit) / len(fit)
    made.weights[0] += np.log(many[1] / many[0]) - np.log(share / (1 - share))
    return made


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD``), difference, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors()
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                d = np.array([difference(t, c) if c else 0.0 for t in part.column("text").cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.scores(d)), pa.array(d)], ["doc_id", "held_out", "score", "difference"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_of().alias("text"))
    return bounded(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, difference double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score at least ``THRESHOLD``, with all their columns; nothing is joined."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = model.compressors()
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                d = np.array([difference(t or b"", c) for t in part.column("text").cast(pa.binary()).to_pylist()])
                yield part.filter(pa.array(model.scores(d) >= THRESHOLD))

    if model.weights is None:
        return docs
    return bounded(docs.select(names)).mapInArrow(run, schema)
