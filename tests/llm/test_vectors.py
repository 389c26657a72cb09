"""Vector codes against a search of all entries in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomsheet.llm import vectors
from loomsheet.llm.vectors import Book

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def plain(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of rows of vec_id, embedding, label."""
    kept = [(i, [math.floor(1024 * x) for x in e], label) for i, e, label in rows if e and len(e) % 4 == 0 and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i8").tobytes(), len(r[1])))
    width = len(order[0][1])
    kept, order = [r for r in kept if len(r[1]) == width], [r for r in order if len(r[1]) == width][:entries]
    w = width // 4
    cut = lambda v: [tuple(v[k * w : k * w + w]) for k in range(4)]
    books = [list(b) for b in zip(*[cut(v) for _, v, _ in order], strict=True)]

    def nearest(part, book):
        return min(((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), i) for i, c in enumerate(book)))

    for _ in range(rounds):
        for k in range(4):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(cut(v)[k], books[k])[1], []).append(cut(v)[k])
            for i, parts in held.items():
                books[k][i] = tuple(sum(x) // len(parts) for x in zip(*parts, strict=True))
    out, sums = [], {}
    for i, v, label in kept:
        found = [nearest(p, b) for p, b in zip(cut(v), books, strict=True)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vectors.encode(df, **how).collect()), key=str)


def test_odd_rows(spark):
    """Nulls in each column, NaN, infinities, other lengths, repeats, ties, far values."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 0.5, -0.25, 1 / 3]) for _ in range(8)], k % 3 or None) for k in range(60)]
    rows += [(5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (None, [0.1] * 8, None), (70, None, 1), (71, [], 1), (72, [0.1] * 7 + [None], 1), (73, [0.1] * 7 + [float("nan")], 1), (74, [float("-inf")] + [0.1] * 7, 1)]
    rows += [(75, [0.1] * 4, 1), (76, [0.1] * 6, 1), (77, [-0.0] * 8, 2)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, entries=16) == plain(rows, entries=16)
    rows += [(80, [40_000.0] + [0.0] * 7, 2), (81, [-90_000.0] * 8, 2)]  # beyond what doubles add exactly
    assert run(spark, rows, entries=16) == plain(rows, entries=16)


def test_more_rows_than_entries(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(10**6), [rng.gauss(0, 1) for _ in range(8)], rng.randrange(4)) for _ in range(400)]
    assert run(spark, rows, rounds=2) == plain(rows, rounds=2)


def test_rare_and_common_labels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT", 10)
    rows = [(k, [k / 7] * 4, 1 if k < 50 else None if k < 60 else k) for k in range(80)]
    assert run(spark, rows, entries=4) == plain(rows, entries=4)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []


def test_beyond_a_long(spark):
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(1, [1e30] * 4, 1)])


@pytest.mark.parametrize("kind", [np.float64, object])
def test_search_is_exact_and_skips_entries(kind, monkeypatch):
    rng = np.random.default_rng(8)
    entries = rng.integers(-300, 300, (256, 4)).astype(kind)
    entries[100:110] = entries[7]
    parts = np.concatenate([rng.integers(-300, 300, (500, 4)), entries[:50].astype(np.int64), np.full((3, 4), 10_000)]).astype(kind)
    book, seen = Book(entries), []

    class Watched(type(book.sorted)):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(key.stop - key.start)
            return super().__getitem__(key)

    book.sorted = book.sorted.view(Watched)
    monkeypatch.setattr(vectors, "TILE", 8)
    index, error = book.nearest(parts)
    far = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == [row.index(min(row)) for row in far.tolist()] and error.tolist() == far.min(axis=1).tolist()
    assert sum(seen) < 0.7 * 256 * -(-len(parts) // 8)
