"""The outline of a log as a document: which event stands where.

The main thread is the reader's path (chains.best_children) from the best start. Beside
each step hang its siblings: a leaf becomes a footnote there, a deeper one a stub and a
section of its own, whose thread goes on by best children. Sections come in the order in
which a reader finds them: those off the main thread, then separate roots, then detached
heads, then those off these, and so on; last what no root reaches.

No walk visits the events one after another. An event's thread and its step are jumps
along the best links; sections form a tree, whose breadth-first order comes from ranks of
its paths, doubled in length in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.board import is_content
from skein.operators.closure import climbed, heights, loops, paths, roots
from skein.operators.ranks import ranked
from skein.operators.tables import checkpointed

#: How the main thread was found, the first rule that applies on it.
RULES = ("selection", "score", "longest", "only")


def placed(events: DataFrame, annotation: str, tombstone: str) -> DataFrame:
    """id, parent_id, top of every content event: parent_id is its first parent on a thread; without one, top says why: root (it names none), detached (none is there) or sweep (only annotations are, or it is the least id of a cycle of first parents, where that is cut)."""
    content = events.where(is_content(annotation, tombstone)).select("id", F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))
    up = content.select("id", F.posexplode("parents").alias("pos", "parent"))
    known = events.select(F.col("id").alias("parent"), is_content(annotation, tombstone).alias("__on"))
    found = up.join(known, "parent").groupBy("id").agg(F.min_by("parent", F.when(F.col("__on"), F.col("pos"))).alias("parent_id"))
    top = F.when(F.col("parent_id").isNotNull(), None).when(F.size("parents") == 0, "root").when(F.col("__seen"), "sweep").otherwise("detached")
    rows = content.join(found.withColumn("__seen", F.lit(True)), "id", "left").withColumn("__seen", F.coalesce("__seen", F.lit(False)))
    rows = checkpointed(rows.select("id", "parent_id", top.alias("top")))
    cut = loops(rows).where("node = first").select(F.col("node").alias("id"), F.lit(True).alias("__cut"))
    rows = rows.join(cut, "id", "left")
    return checkpointed(rows.select("id", F.when(F.col("__cut").isNull(), F.col("parent_id")).alias("parent_id"), F.when(F.col("__cut"), "sweep").otherwise(F.col("top")).alias("top")))


def _picked(rows: DataFrame, group: list[str]) -> DataFrame:
    """child, rule for each group of siblings (id, below, selected, rank), as in chains.best_children."""
    key = F.struct((-F.coalesce("selected", F.lit(0))).alias("s"), F.coalesce("rank", F.lit(2**62)).alias("r"), (-F.col("below")).alias("b"), "id")
    best = rows.groupBy(*group).agg(F.min(key).alias("k"), F.count("*").alias("n"), F.max(F.coalesce("selected", F.lit(0))).alias("s"), F.count("rank").alias("scored"))
    rule = F.when(F.col("n") == 1, "only").when(F.col("s") > 0, "selection").when(F.col("scored") > 0, "score").otherwise("longest")
    return best.select(*group, F.col("k.id").alias("child"), rule.alias("rule"))


def outline(nodes: DataFrame, board: DataFrame, head: str | None = None) -> DataFrame:
    """id, role, section, place, number, kind, parent_id, instead, below, rule, a row for each place of an event.

    nodes: id, parent_id, top (placed()); board: id, selected, rank (null without a score).
    role is thread (in section, 0 the main thread, at place from 0), footnote (a leaf
    beside that place) or stub (the head of a section beside it); number counts footnotes
    and stubs in the order of the document. kind is the section's: main, branch, root,
    detached or sweep. instead is the sibling that the thread went on with, rule the way a
    thread's event was picked. With head, the main thread is the way from its root to it.
    An empty log gives no rows.
    """
    rows = nodes.join(heights(nodes).withColumnRenamed("node", "id"), "id").join(board.select("id", "selected", "rank"), "id", "left")
    rows = checkpointed(rows)
    best = _picked(rows.where("parent_id is not null"), ["parent_id"])
    if head is None:
        tops = rows.where("parent_id is null")
        first = tops.agg(F.min(F.when(F.col("top") == "root", 0).when(F.col("top") == "detached", 1).otherwise(2))).first()[0]
        start = _picked(tops.where(F.col("top") == ("root", "detached")[first]), []) if first in (0, 1) else tops.agg(F.min("id").alias("child")).withColumn("rule", F.lit("only"))
        start = start.where("child is not null").select(F.lit(None).cast("string").alias("parent_id"), "child", "rule")
    else:
        _, jumps = climbed(nodes)
        way = paths(nodes.where(F.col("id") == head).select(F.col("id").alias("node")), jumps)
        way = checkpointed(way.join(nodes.select(F.col("id").alias("at"), "parent_id"), "at").select("parent_id", F.col("at").alias("child"), F.lit("override").alias("rule")))
        if way.isEmpty():
            raise ValueError(f"{head} is no event on a thread of this log")
        best = best.join(way.select(F.col("child").alias("parent_id")), "parent_id", "left_anti").unionByName(way.where("parent_id is not null"))
        start = way.where("parent_id is null")
    picks = checkpointed(best.unionByName(start))
    chosen = picks.select(F.col("child").alias("id"), "rule")
    beside = picks.where("parent_id is not null").select("parent_id", F.col("child").alias("instead"))
    # a thread is a chain of picked links
    linked = rows.select("id", "parent_id").join(chosen, "id", "left")
    threads = roots(linked.select("id", F.when(F.col("rule").isNotNull(), F.col("parent_id")).alias("parent_id")))
    threads = checkpointed(rows.select("id", "parent_id", "top", "below").join(threads.select(F.col("node").alias("id"), F.col("root").alias("head"), F.col("depth").alias("place")), "id").join(chosen, "id", "left"))
    main = (start.select("child").first() or [None])[0]

    # what hangs beside a step: the head of a chain whose parent goes on with another child
    above = threads.select(F.col("id").alias("parent_id"), F.col("head").alias("up"), (F.col("place") + 1).alias("at"))
    hanging = checkpointed(threads.where("place = 0 and parent_id is not null").join(above, "parent_id").join(beside, "parent_id", "left").select("id", "parent_id", "below", "up", "at", "instead"))
    beside_steps = hanging.where("instead is not null")
    # heads of sections; below an override's head nothing is picked, so its children count as tops that no root reaches
    tops = threads.where("place = 0 and parent_id is null").select("id", "top").unionByName(hanging.where("instead is null").select("id", F.lit("sweep").alias("top")))
    leaf = F.col("below") == 0
    heads = tops.select("id", F.when(F.col("id") == main, "main").otherwise(F.col("top")).alias("kind"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("at")).unionByName(beside_steps.where(~leaf).select("id", F.lit("branch").alias("kind"), "up", "at"))
    ordinary = F.col("kind").isin("root", "detached")
    heads = checkpointed(heads.select("id", "kind", F.when(ordinary, F.lit(main)).otherwise(F.col("up")).alias("parent_id"), "at"))
    sections = _numbered(heads)

    number = sections.select(F.col("id").alias("head"), "section", "kind")
    on = threads.join(number, "head").select("id", F.lit("thread").alias("role"), "section", "place", F.lit(None).cast("long").alias("number"), "kind", "parent_id", F.lit(None).cast("string").alias("instead"), "below", "rule")
    notes = beside_steps.join(number, F.col("up") == F.col("head"))
    notes = ranked(notes.select("id", F.when(leaf, "footnote").otherwise("stub").alias("role"), "section", F.col("at").alias("place"), "kind", "parent_id", "instead", "below"), ["section", "place", "id"], "number")
    # a section's own head says what its thread was left for
    own = beside_steps.where(~leaf).select("id", F.col("instead").alias("__instead"))
    on = on.join(own, "id", "left").withColumn("instead", F.col("__instead")).drop("__instead")
    return on.unionByName(notes.withColumn("rule", F.lit(None).cast("string")).select(on.columns))


def _numbered(heads: DataFrame, rounds: int = 40) -> DataFrame:
    """heads (id, kind, parent_id, at) with section: 0 the main thread, then by level from it, in a level by the places on the way from the top; what no root reaches comes last, by id."""
    level = roots(heads.select("id", "parent_id")).select(F.col("node").alias("id"), F.col("depth").alias("level"), F.col("root").alias("__top"))
    swept = heads.where("kind = 'sweep'").select(F.col("id").alias("__top"), F.lit(True).alias("__swept"))
    rows = heads.join(level, "id").join(swept, "__top", "left")
    order = F.when(F.col("kind") == "root", 1).when(F.col("kind") == "detached", 2).otherwise(0)
    state = ranked(rows.select("id", "kind", "level", F.coalesce("__swept", F.lit(False)).alias("swept"), F.col("parent_id").alias("up"), order.alias("o"), "at"), ["o", "at", "id"], "rank")
    state = checkpointed(state)
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        far = state.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("rank").alias("__rank"))
        pair = state.join(far, "up", "left").select("id", "kind", "level", "swept", F.col("__up").alias("up"), F.coalesce("__rank", F.lit(0)).alias("a"), F.col("rank").alias("b"))
        state = checkpointed(ranked(pair, ["a", "b"], "rank").drop("a", "b"))
    last = F.when(F.col("swept"), 0).otherwise(F.col("level"))
    out = ranked(state, ["swept", last, F.when(F.col("swept"), 0).otherwise(F.col("rank")), "id"], "section", 0)
    return out.select("id", F.when(F.col("swept"), "sweep").otherwise(F.col("kind")).alias("kind"), "section")


def main_rule(rows: DataFrame) -> str:
    """The rule that names the main thread (rows: outline())."""
    found = {r[0] for r in rows.where("role = 'thread' and section = 0").select("rule").distinct().collect()}
    return next((r for r in ("override", *RULES) if r in found), "only")
