"""Cycles of any number of parents against a plain search, and heights of long ladders in few rounds."""

import random

import pytest

from skein.operators import closure, log


def plain_version(links):
    up = {}
    for a, b in links:
        up.setdefault(a, set()).add(b)

    def above(x):
        seen, todo = set(), list(up.get(x, ()))
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += up.get(y, ())
        return seen

    reach = {x: above(x) for x in {a for p in links for a in p}}
    return sorted((x, min(y for y in r if x in reach[y])) for x, r in reach.items() if x in r)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    dealt = random.Random(seed)
    n = 40
    links = [(f"n{i}", f"n{dealt.randrange(i)}") for i in range(1, n) for _ in range(dealt.choice((1, 1, 2)))]
    links += [(f"n{dealt.randrange(n)}", f"n{dealt.randrange(n)}") for _ in range(seed * 2)]
    if seed == 3:
        links += [("n5", "n5"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d")]
    found = closure.cyclic(spark.createDataFrame(links, "node string, parent string")).collect()
    assert sorted((r.node, r["first"]) for r in found) == plain_version(links)


def test_ladder_and_long_cycle(spark):
    """A ladder of calls and answers, where every answer has two parents, ends after a few rounds."""
    ladder = [(f"r{i:05d}", f"r{i - 1:05d}") for i in range(1, 3000)] + [(f"r{i:05d}", f"r{i - 2:05d}") for i in range(2, 3000, 3)]
    assert closure.cyclic(spark.createDataFrame(ladder, "node string, parent string")).isEmpty()
    ring = [(f"c{i:05d}", f"c{(i + 1) % 1500:05d}") for i in range(1500)] + [("t1", "c00007"), ("t2", "t1"), ("c00009", "r00001")]
    found = closure.cyclic(spark.createDataFrame(ladder + ring, "node string, parent string")).collect()
    assert len(found) == 1500 and {r["first"] for r in found} == {"c00000"}


def test_loops_of_first_parents(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None), ("e", "d"), ("f", "f"), ("g", "gone")], "id string, parent_id string")
    assert sorted(map(tuple, closure.loops(nodes).collect())) == [("a", "a"), ("b", "a"), ("f", "f")]


def test_obstacles(spark):
    line = lambda i, parents: f'{{"v":1,"id":"{i}","kind":"n/x","at":"2026-01-01T00:00:00Z","author":{{"actor":"me"}},"parents":[{",".join(chr(34) + p + chr(34) for p in parents)}],"payload":{{}}}}'
    texts = [line("a", ["b", "gone"]), line("b", ["a"]), line("c", ["a", "x"]), line("d", ["gone"]), line("x", []), line("x", ["d"])]
    rows = log.classified(spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line long, text string"))
    found = log.obstacles(log.eligible(rows), rows.where("class = 'conflict-variant'").select("id")).collect()
    assert sorted(map(tuple, found)) == [("cycle", "a", "a"), ("cycle", "a", "b"), ("missing", "gone", "gone"), ("unavailable", "x", "x")]
    summed = {(r.what, r.subject): r.n for r in log.diagnostics(rows).collect()}
    assert summed[("cycle", "a")] == 2 and summed[("missing", "gone")] == 2
