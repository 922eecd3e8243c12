"""op11 against a plain version, and insertions and deletions against an index that never held what was deleted."""

import random

import numpy as np
import pytest

from skein.llm import lines
from skein.llm.common import tune


def plain_version(rows):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: lines.NO_ID if i is None else i
    held = {}
    for i, parts in split:
        for x in parts:
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(order(i))
    out = []
    for i, parts in split:
        stay = [x for x in parts if not (key(x) in held and len(held[key(x)]) > 1 and min(held[key(x)]) != order(i))]
        out.append((i, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


def texts(seed, n=120):
    dealt = random.Random(seed)
    pool = [f"  Line number {i} of the pool\t" if i % 3 else f"LINE NUMBER {i} OF THE POOL" for i in range(40)] + ["short", "é" * 9, "é" * 10, " \x0b ", "", " nine chars", "x" * 5000, "ÀB" * 5]
    return [(i, "\n".join(dealt.choice(pool) if dealt.random() < 0.7 else f"own line {dealt.random()}" for _ in range(dealt.randrange(8)))) for i in range(n)]


def test_line_dedup(spark):
    tune(spark)
    rows = [*texts(1), (None, "line number 1 of the pool\nanother line"), (None, "Another Line"), (5, "Line number 1 of the pool"), (5, "twice in one document\ntwice in one document"), (900, None), (901, ""), (902, "\n\n"), (903, "the same line\r\nthe same line")]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, kept long, key binary")
    assert rows_of(lines.line_dedup(docs)) == plain_version(rows)
    index = lines.LineIndex(spark)
    index.insert(docs)
    out = index.deduplicated(docs)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped", "kept"] and rows_of(out) == plain_version(rows)
    index.drop()
    assert lines.line_dedup(docs.where("false")).count() == 0


def exact(index):
    """Every key of the references is in the filters once, and the counts are those of the references."""
    held = {}
    for r in index.references().collect():
        held.setdefault(bytes(r.key), set()).add(r.doc)
    counts = {bytes(r.key): (r.refs, r.owner) for r in index.counts().collect()}
    assert counts == {k: (len(d), min(d)) for k, d in held.items() if len(d) > 1}
    chains = [lines.Chain(bytes(r.filter), index.state["buckets"]) for r in index.filters().collect()]
    assert sum(int((t != 0).sum()) for c in chains for t in c.tables) == len(held)
    by = {r.shard: lines.Chain(bytes(r.filter), index.state["buckets"]) for r in index.filters().collect()}
    for k in held:
        assert by[int.from_bytes(k[:4], "little") % index.state["shards"]].holds([k])[0]


def test_insertions_and_deletions(spark, tmp_path):
    tune(spark)
    rows = texts(2)
    part = lambda lo, hi: spark.createDataFrame(rows[lo:hi], "doc_id long, text string")
    index = lines.LineIndex(spark, str(tmp_path / "index"), shards=3, buckets=8)  # small filters, so that chains grow and fingerprints clash
    index.insert(part(40, 80), batch=0)
    index.insert(part(0, 40), batch=1)
    index.insert(part(0, 40), batch=1)
    index.insert(part(80, 120))
    exact(index)
    assert rows_of(index.deduplicated(part(0, 120))) == plain_version(rows)
    gone = [3, 0, 41, 1, 2, 100, 77, 10**6]
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    index = lines.LineIndex(spark, str(tmp_path / "index"))  # opened again, with its own parameters
    exact(index)
    left = [r for r in rows if r[0] not in gone]
    assert rows_of(index.deduplicated(spark.createDataFrame(left, "doc_id long, text string"))) == plain_version(left)
    index.insert(spark.createDataFrame([r for r in rows if r[0] in gone], "doc_id long, text string"))
    exact(index)
    assert rows_of(index.deduplicated(part(0, 120))) == plain_version(rows)
    index.delete(part(0, 120).select("doc_id"))
    assert not index.references().count() and not index.counts().count()
    assert not any(c.tables[0].any() for c in (lines.Chain(bytes(r.filter), 8) for r in index.filters().collect()) if c.tables)
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("manifest")]) == 1


@pytest.mark.parametrize("n", [10, 1000, 40000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = [rng.bytes(16) for _ in range(n)]
    chain = lines.Chain(b"", 1 << 10)
    chain.insert(keys)
    assert chain.holds(keys).all() and sum(int((t != 0).sum()) for t in chain.tables) == n
    chain.delete(keys[::2])
    assert chain.holds(keys[1::2]).all()
    strange = [rng.bytes(16) for _ in range(20000)]
    assert chain.holds(strange).mean() < 0.01
    with pytest.raises(ValueError):
        lines.Chain(b"", 8).delete([b"0" * 16])
