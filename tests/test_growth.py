"""Which rows the rounds of jumps carry."""

from skein.operators import closure, log
from skein.plans import views
from skein.sinks.training import TrainingData

SF = "/root/testdata/sf0.001"


def test_only_inner_nodes_climb_and_only_children_jump(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, None if i < 3 else i // 3) for i in range(200)] + [(900, 899)], "id long, parent_id long")
    sizes, real = [], closure.checkpointed
    monkeypatch.setattr(closure, "checkpointed", lambda df: (sizes.append((out := real(df)).count()), out)[1])
    up = {i: None if i < 3 else i // 3 for i in range(200)} | {900: None}
    below, way = dict.fromkeys(up, 0), {}
    for i in up:
        at, n = i, 0
        while up[at] is not None:
            at, n = up[at], n + 1
            below[at] = max(below[at], n)
        way[i] = (at, n)
    assert {r[0]: r[1] for r in closure.heights(nodes).collect()} == below
    assert set(sizes) == {len(set(up.values()) - {None})}
    sizes.clear()
    assert {r[0]: (r[1], r[2]) for r in closure.roots(nodes).collect()} == way
    assert set(sizes) == {197}


def test_events_on_nobodys_way_are_not_climbed(spark):
    rows = log.classified(views.training_lines(spark, SF))
    data, both = TrainingData(rows, "log/annotation", paired=False), TrainingData(rows, "log/annotation")
    judged = {r[0] for r in data.board.select("target").collect()} | {c for r in data.selections.collect() for c in r["chosen"]}
    parents = {r[0] for r in data.events.select("parent").collect()}
    climbed = {r[0] for r in data.faults.select("id").collect()}
    assert climbed == {r[0] for r in data.events.select("id").collect()} & (judged | parents)
    assert len(climbed) < data.events.count()
    shown = lambda d: sorted(map(str, d.sft().select("target", "skip", "weight", "prompt", "completion").collect()))
    assert shown(data) == shown(both)
