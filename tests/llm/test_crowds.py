"""Look-alikes of one text that hide linked pairs, however many tasks share them."""

import numpy as np
import pyarrow as pa

from skein.llm import neardup
from skein.llm.common import tune
from skein.llm.neardup import near_duplicates


def crowd(n):
    rng = np.random.default_rng(4)
    base, rows = [f"b{i}" for i in range(200)], []
    for k in range(n // 2):
        own = list(base)
        for j, i in enumerate(rng.choice(200, 9, False)):
            own[i] = f"u{k}_{j}"
        two = list(own)
        for j, i in enumerate(rng.choice(200, 10, False)):
            two[i] = f"v{k}_{j}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(two))]
    return rows


def similarity(a, b):
    a, b = ({*zip(w, w[1:], strict=False)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_crowd_of_look_alikes(spark):
    tune(spark)
    rows = crowd(1200)
    linked = [k for k in range(600) if similarity(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8]
    assert len(linked) > 550
    found = []
    for parts in (1, 16):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found.append({r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).select("doc_id", "component_id").collect()})
    assert all(found[0][2 * k] == found[0][2 * k + 1] for k in linked)
    assert found[0] == found[1]


def test_no_pair_of_a_region_is_dropped():
    """Of 40 classes that agree alike, each meets all others, not the best few; pairs of one root or one crowd are left out."""
    n, rng = 40, np.random.default_rng(11)
    sig = np.tile(rng.integers(0, 256, neardup.HASHES, np.uint8), (n, 1))
    for k in range(n):
        sig[k, rng.choice(neardup.HASHES, 10, False)] ^= 255
    root, crowd = [0, 0, *range(2, n)], [-1] * (n - 2) + [7, 7]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in ([5] * n, range(n), root, crowd, [100] * n)] + [pa.array([x.tobytes() for x in m]) for m in (sig[:, : neardup.DEEPER], sig)],
        names=["region", "node", "root", "crowd", "n", "deep", "sig"],
    )
    found = [p for b in neardup._candidates(0.8, True)(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted(found) == [(i, j) for i in range(n) for j in range(i + 1, n) if (i, j) not in ((0, 1), (n - 2, n - 1))]


def test_crowds_in_many_blocks(spark, monkeypatch):
    """Classes over many small blocks, of several sizes, against all pairs."""
    tune(spark)
    monkeypatch.setattr(neardup, "WINDOW", 2)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rows = [(d, t if d % 3 else t + "".join(f" x{i}" for i in range(d % 60))) for d, t in crowd(70)]
    low = {d: d for d, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            if similarity(a, b) >= 0.8:
                x, y = low[i], low[j]
                low = {k: min(x, y) if v in (x, y) else v for k, v in low.items()}
    assert 20 < len(set(low.values())) < 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()} == low


def test_shared_shingles():
    """Counts by matrices and pair by pair are those of plain sets, in chunks of any width."""
    rng = np.random.default_rng(5)
    make = lambda n: [np.unique(np.concatenate([rng.choice(np.arange(40, dtype=np.uint64), 25), rng.integers(100, 3000, k).astype(np.uint64)])) for k in rng.integers(0, 60, n)]
    a, b = make(90), make(130)
    wanted = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    kept = neardup.CELLS
    try:
        for neardup.CELLS in (kept, 1000, 7):
            assert neardup._shared(a, b).tolist() == wanted
    finally:
        neardup.CELLS = kept
