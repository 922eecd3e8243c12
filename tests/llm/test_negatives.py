"""op12 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import negatives, topk
from skein.llm.common import tune


def brute(rows, k=5, percent=80):
    kept = [(n, i, int(label), [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, label, v) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, v in kept:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, l == label) for m, j, l, w in kept if m != n and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fit = [(t, j) for t, j, same in scored if not same and percent * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank string")
    v = topk.integer_vectors(df, "vec_id", "embedding", 256, ["label"])
    return negatives.hard_negatives(v, F.col("id") % 100 == 0, **more)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    tune(spark)
    if small:  # several blocks and shards, and few estimates at a time
        for name, x in (("ANCHORS", 3), ("ROWS", 60), ("CELLS", 50)):
            monkeypatch.setattr(negatives, name, x)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 9))
    rows = [(i * 10, int(rng.integers(3)), [float(x) for x in (centre[i % 4] + rng.normal(size=9)) * rng.choice([0.2, 1, 2])]) for i in range(400)]
    # repeated rows, ties, nulls, other dimensions, an anchor alone with its label, zero vectors
    rows += [(100, 1, rows[3][2]), (100, 1, rows[3][2]), (7, 2, rows[10][2]), (8, 1, rows[10][2]), (200, 0, rows[20][2]), (None, 1, [1.0] * 9), (300, None, [1.0] * 9), (400, 1, None), (500, 1, [1.0, None] + [0.0] * 7), (600, 1, [math.nan] * 9), (700, 1, [math.inf] * 9)]
    rows += [(800, 1, [1.0, 2.0]), (801, 1, [3.0, 4.0]), (802, 2, [2.9, 4.0]), (900, 77, [0.5] * 9), (1000, 1, [0.0] * 9), (1001, 2, [0.0] * 9), (1100, 1, []), (1101, 1, []), (1102, 2, [])]
    assert found(mined(spark, rows, sample=100)) == brute(rows)
    assert found(mined(spark, rows, sample=5, positives=2, negatives=2, percent=95)) == brute(rows, 2, 95)


def test_crowd_of_equal_rows_and_large_components(spark):
    rows = [(i, i % 2, [1.0, 2.0, 3.0]) for i in range(600)] + [(1000, 0, [1e6, -1e6, 1e6]), (1001, 1, [1e6, -1e6, 0.9e6]), (1002, 0, [1e6, -1e6, 1e6])]
    assert found(mined(spark, rows)) == brute(rows)


def test_empty(spark):
    assert mined(spark, [(1, None, [1.0])]).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(500, 7)) * rng.choice([1, 100, 1e7], 500)[:, None]).astype(np.int64)
    for book in (negatives.book_of({}, 7), [rng.normal(size=(negatives.CENTRES, p.stop - p.start)) * 50 for p in negatives._pieces(7)]):
        codes, rest = negatives.encode(x, book)
        made = negatives.pa.table({"id": np.arange(500), "label": np.zeros(500, int), "v": [r.tobytes() for r in x], "codes": [r.tobytes() for r in codes], "rest": [r.tobytes() for r in rest]})
        low, high = negatives.Rows(made, 7, book).bounds(x[:50])
        true = x[:50].astype(object) @ x.T.astype(object)
        assert (low <= true).all() and (true <= high).all()
