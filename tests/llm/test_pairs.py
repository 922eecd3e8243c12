"""op1, op2, op4 against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from skein.llm import neardup, repeats, topk
from skein.llm.common import tune
from skein.llm.graph import components


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def brute_topk(rows, k):
    kept = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for n, (q, v) in enumerate(kept):
        if q % 100:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), c) for m, (c, w) in enumerate(kept) if m != n and len(w) == len(v)))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)]
    return sorted(out, key=repr)


def test_topk(spark, monkeypatch):
    tune(spark)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "STRIP", 16)
    rng = np.random.default_rng(1)
    rows = [(i * 10, [float(x) for x in rng.normal(size=8) * rng.choice([0.1, 1, 3])]) for i in range(300)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (7, rows[10][1]), (None, [1.0] * 8), (200, None), (300, [1.0, None] + [0.0] * 6), (400, [math.nan] * 8), (500, [math.inf] * 8), (600, [1.0, 2.0]), (601, [3.0, 4.0]), (700, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    assert rows_of(topk.topk(v.where("id % 100 = 0"), v, 10), "query_id", "rank", "vec_id", "score") == brute_topk(rows, 10)
    none = v.where("false")
    assert topk.topk(none, none, 10).count() == 0


def test_topk_of_large_components_and_equal_lengths(spark, monkeypatch):
    """Components far beyond 32 bits keep their exact scores; beyond 64 bits scores stop at the ends."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rows = [(0, [1e7, 1.0]), (100, [0.5, 0.25]), (1, [1.0, -1.0]), (2, [2.0**30, 3.0]), (3, [-1.0, 1.0])] + [(i, [1.0, 0.0]) for i in range(4, 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.topk(v.where("id % 100 = 0"), v, 10).collect()}
    assert found == {(q, r): (c, min(s, 2**63 - 1)) for q, r, c, s in brute_topk(rows, 10)}
    wide = np.array([[2**62, 2**62], [1, 1]])
    assert topk.products(wide, wide).tolist() == [[2**63 - 1, 2**63 - 1], [2**63 - 1, 2]]


def brute_components(rows, size):
    sets = [set(neardup.shingle_set(t, size).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(a), low.get(top(i)) if a else d) for i, ((d, _), a) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, monkeypatch, size):
    tune(spark)
    monkeypatch.setattr(neardup, "WINDOW", 2)
    rng = random.Random(size)
    words = [f"w{i}" for i in range(300)]
    edit = lambda d, k: [rng.choice(words) if rng.random() < k / len(d) else x for x in d]
    base = [rng.choice(words) for _ in range(120)]
    texts = [" ".join(edit(base, rng.randint(0, 7))) for _ in range(60)]
    for _ in range(15):
        b = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        texts += [" ".join(edit(b, rng.randint(0, 3))) for _ in range(rng.randint(1, 4))]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "oNE\n"), (905, "two Words"), (906, "TWO\twords"), (None, "null id here too"), (907, "null id here too"), (907, "null id here too"), (None, "only null words here")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    out = neardup.near_duplicates(df, shingle=size)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_components(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_near_duplicates_of_crowds(spark):
    """Variants of one text that are near that text only, and look-alikes that are linked with nothing, in regions far over the window."""
    tune(spark)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(200)]
    edit = lambda k: [rng.choice(words) if i in at else x for at in [set(rng.sample(range(200), k))] for i, x in enumerate(base)]
    rows = [(i, " ".join(base if i == 250 else edit(rng.randint(14, 20) if i % 2 else rng.randint(30, 36)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.near_duplicates(df, shingle=2)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_components(rows, 2)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, 301), (301, 302), (300, 302)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 300, 301: 300, 302: 300}


def brute_repeats(rows):
    counts = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        counts.update(d[i : i + 200] for i in range(len(d) - 199))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 2, bool)
        for at in range(len(d) - 199):
            if counts[d[at : at + 200]] > 1:
                gone[at + 1 : at + 201] = True
        kept = np.frombuffer(d, np.uint8)[~gone[1:-1]].tobytes()
        out.append((i, len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark):
    tune(spark)
    rng = random.Random(4)
    some = lambda n, of="abcdefghij é ": "".join(rng.choice(of) for _ in range(n))
    passages = [some(n) for n in (199, 200, 201, 230, 300, 700)]
    texts = ["".join(rng.choice([some(rng.randint(0, 200)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :]]) for _ in range(rng.randint(0, 5))) for _ in range(50)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "a" * 199), (103, "b" * 200), (104, "c" * 201), (105, "d" * 450), (106, "xyz" * 150), (107, some(50) * 9), (108, some(150) * 2 + some(30)), (None, passages[3]), (5, texts[5]), (5, texts[5]), (109, "a" * 300 + some(40) + "a" * 260)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes long")
    assert rows_of(repeats.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
    assert repeats.remove_repeats(df.where("false")).count() == 0


def test_long_text_is_hashed_in_parts():
    data = np.random.default_rng(0).integers(0, 256, 200_000).astype(np.uint8)
    h = repeats.rolling_hashes(data)
    for at in (0, 65_430, 65_536, 199_900):
        assert h[at] == repeats.rolling_hashes(data[at : at + repeats.TRIGGER])[0]
