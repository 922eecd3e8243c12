"""Ancestors over single-parent links, by pointer doubling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.tables import checkpointed


class CycleError(ValueError):
    """Parent links form a cycle."""


def present_edges(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """node, parent: links whose parent is itself a node."""
    up = nodes.select(F.col("id").alias("__p"))
    return nodes.select(F.col("id").alias("node"), F.col(parent).alias("parent")).join(up, F.col("parent") == F.col("__p")).drop("__p")


def roots(nodes: DataFrame, parent: str = "parent_id", rounds: int = 40) -> DataFrame:
    """node, root, depth for every node: one row each, log2(depth) rounds of jumps of those with a parent.

    A cycle, or a chain longer than 2 ** rounds, raises CycleError.
    """
    # only nodes with a parent jump; end: up has none, so it is the root
    linked = present_edges(nodes, parent)
    further = linked.select(F.col("node").alias("parent"), F.lit(False).alias("__end"))
    state = checkpointed(linked.join(further, "parent", "left").select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("__end", F.lit(True)).alias("end")))
    for _ in range(rounds):
        if state.where("not end").isEmpty():
            out = nodes.select(F.col("id").alias("node")).join(state, "node", "left")
            return out.select("node", F.coalesce("up", "node").alias("root"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
        if state.agg(F.max("depth")).first()[0] > 2 * state.count():
            raise CycleError("parent links form a cycle")
        far = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__more"), F.col("end").alias("__end"))
        step = state.join(far, "up", "left")
        moved = (F.when(F.col("end"), F.col(c)).otherwise(x).alias(c) for c, x in (("up", F.col("__up")), ("depth", F.col("depth") + F.col("__more"))))
        state = checkpointed(step.select("node", *moved, (F.col("end") | F.col("__end")).alias("end")))
    raise CycleError("parent links form a cycle")


def loops(nodes: DataFrame, parent: str = "parent_id", rounds: int = 40) -> DataFrame:
    """node, first of every node on a cycle of parent links; first is the cycle's least id. Nodes that only hang on a cycle aren't on it.

    Jumps double until none is left, or until they are longer than any chain: then each
    pointer stands on a cycle, and every node of a cycle is pointed at.
    """
    state = checkpointed(present_edges(nodes, parent).select("node", F.col("parent").alias("up"), F.col("node").alias("first")))
    total = state.count()
    for i in range(rounds):
        if 2**i > 2 * total:
            break
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("first").alias("first2"))
        state = checkpointed(state.join(far, "up").select("node", F.col("up2").alias("up"), F.least("first", "first2").alias("first")))
        if state.isEmpty():
            break
    return state.join(state.select(F.col("up").alias("node")).distinct(), "node", "left_semi").select("node", "first")


def _held_up(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node of those above which some cycle lies; links (node, parent) of any number of parents.

    A node without links is free, and so is one whose parents all are. Runs of nodes with
    one parent each are jumped over by doubling, and a node's parents that stand for the
    same node above become one; so a ladder, where parents lead to the same place again,
    shrinks as fast as a chain. Rounds end when no link goes any more.
    """
    edges = checkpointed(links.select("node", "parent").distinct())
    before = None
    while True:
        edges = checkpointed(edges.join(edges.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent"))
        n = edges.agg(F.count("*"), F.count(F.when(F.col("node") == F.col("parent"), 1)), F.sum(F.xxhash64("node", "parent").cast("decimal(38,0)"))).first()
        if not n[0] or n == before:
            return edges.select("node").distinct()
        before = n
        # a node that leads to itself stays as it is
        single = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("up")).where("n = 1 and up != node").select("node", "up")
        state = single.join(single.select(F.col("node").alias("up"), F.lit(False).alias("end")), "up", "left").select("node", "up", F.coalesce("end", F.lit(True)).alias("end"))
        state, total = checkpointed(state), edges.count()
        for i in range(rounds):
            if state.where("not end").isEmpty() or 2**i > 2 * total:
                break
            far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("end").alias("end2"))
            # one join of all rows, as a union of what is done and what isn't would double the tasks in each round
            state = checkpointed(state.join(far, "up", "left").select("node", F.when(F.col("end"), F.col("up")).otherwise(F.col("up2")).alias("up"), (F.col("end") | F.col("end2")).alias("end")))
        # those that never end are on a cycle of such nodes, or above one
        stands = state.select(F.col("node").alias("parent"), F.when(F.col("end"), F.col("up")).otherwise(F.col("node")).alias("as"))
        moved = edges.join(stands, "parent", "left").select("node", F.coalesce("as", "parent").alias("parent"))
        stuck = state.where("not end").select("node", F.col("node").alias("parent"))
        edges = moved.join(stuck.select("node"), "node", "left_anti").unionByName(stuck).distinct()


def cyclic(links: DataFrame) -> DataFrame:
    """node, first of every node on a cycle of links (node, parent; any number of parents); first is the least of the nodes that it shares cycles with.

    Nodes without a cycle above or below them go first. Where those left have one parent
    each they are cycles, and jumps find them; only else the pairs of nodes that reach
    each other are built, of these few.
    """
    links = checkpointed(links.select("node", "parent").where("node is not null and parent is not null").distinct())
    up = checkpointed(_held_up(links))
    if up.isEmpty():
        return up.select("node", F.col("node").alias("first"))
    some = links.join(up, "node", "left_semi").join(up.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    both = checkpointed(_held_up(some.select(F.col("parent").alias("node"), F.col("node").alias("parent"))))
    core = checkpointed(some.join(both, "node", "left_semi").join(both.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent"))
    if core.groupBy("node").count().where("count > 1").isEmpty():
        return loops(core.select(F.col("node").alias("id"), F.col("parent").alias("parent_id")))
    reach, size = core, -1
    while size != (now := reach.count()):
        size = now
        far = reach.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        reach = checkpointed(reach.unionByName(reach.join(far, "parent").select("node", F.col("above").alias("parent"))).distinct())
    mutual = reach.join(reach.select(F.col("node").alias("parent"), F.col("parent").alias("node")), ["node", "parent"])
    return mutual.groupBy("node").agg(F.min("parent").alias("first"))


def heights(nodes: DataFrame, parent: str = "parent_id", rounds: int = 40) -> DataFrame:
    """node, below: how far its deepest descendant lies. A row for each node with a child in every round; rounds grow with the logarithm of the depth."""
    # nodes without a child are 0; only the others are carried from round to round, from 1
    links = present_edges(nodes, parent)
    state = links.select(F.col("parent").alias("node")).distinct().join(links, "node", "left")
    state = checkpointed(state.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("below")))
    total = state.count()
    for i in range(rounds):
        if state.where("up is not null").isEmpty():
            out = nodes.select(F.col("id").alias("node")).join(state.select("node", "below"), "node", "left")
            return out.select("node", F.coalesce("below", F.lit(0).cast("long")).alias("below"))
        if 2**i > 2 * total:
            break
        # up lies 2 ** i above; below is right for descendants nearer than that
        more = state.where("up is not null").groupBy(F.col("up").alias("node")).agg((F.max("below") + 2**i).alias("more"))
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        state = state.join(more, "node", "left").join(far, "up", "left").select("node", F.col("up2").alias("up"), F.greatest("below", "more").alias("below"))
        state = checkpointed(state)
    raise CycleError("parent links form a cycle")


def nearest(nodes: DataFrame, kept: Column, parent: str = "parent_id", rounds: int = 40) -> DataFrame:
    """node, ancestor: the closest ancestor for which kept holds, null where there is none; jumps over the others double."""
    flags = nodes.select(F.col("id").alias("parent"), F.coalesce(kept, F.lit(False)).alias("done"))
    state = nodes.select(F.col("id").alias("node")).join(present_edges(nodes, parent), "node", "left").join(flags, "parent", "left")
    state = checkpointed(state.select("node", F.col("parent").alias("at"), F.coalesce("done", F.lit(True)).alias("done")))
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            return state.select("node", F.col("at").alias("ancestor"))
        far = state.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("done").alias("done2"))
        state = checkpointed(state.join(far, "at", "left").select("node", F.when(F.col("done"), F.col("at")).otherwise(F.col("at2")).alias("at"), (F.col("done") | F.col("done2")).alias("done")))
    raise CycleError("parent links form a cycle")


def climbed(nodes: DataFrame, parent: str = "parent_id", anywhere: Mapping[str, Column] | None = None, least: Mapping[str, Column] | None = None, rounds: int = 40) -> tuple[DataFrame, list[DataFrame]]:
    """node, root, depth and what lies on the way, a row for each node; and the jumps, tables (node, up), the i-th 2 ** i links up.

    anywhere: conditions by name, true where one holds at the node or above it; least:
    values by name, the least at the node or below it. Work is a row for each node in
    every round; rounds grow with the logarithm of the depth.
    """
    anywhere, least = dict(anywhere or {}), dict(least or {})
    own = nodes.select(F.col("id").alias("node"), *(F.coalesce(c, F.lit(False)).alias(n) for n, c in anywhere.items()), *(c.alias(n) for n, c in least.items()))
    state = own.join(present_edges(nodes, parent), "node", "left")
    state = checkpointed(state.select("node", F.col("parent").alias("up"), F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *anywhere, *least))
    total, jumps = state.count(), []
    for i in range(rounds):
        jump = state.where("up is not null").select("node", "up")
        if jump.isEmpty():
            return state.drop("up"), jumps
        if 2**i > 2 * total:
            break
        jumps.append(jump)
        # a row covers the node and what lies less than 2 ** i above; for least, less than 2 ** i below
        far = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("root").alias("__root"), (F.col("depth") + 2**i).alias("__depth"), *(F.col(n).alias(f"__{n}") for n in anywhere))
        step = state.join(far, "up", "left")
        if least:
            below = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(*(F.min(n).alias(f"__{n}") for n in least))
            step = step.join(below, "node", "left")
        either = (F.col(n) | F.coalesce(f"__{n}", F.lit(False)) for n in anywhere)
        state = checkpointed(
            step.select(
                "node",
                F.col("__up").alias("up"),
                F.coalesce("__root", "root").alias("root"),
                F.coalesce("__depth", "depth").alias("depth"),
                *(c.alias(n) for n, c in zip(anywhere, either, strict=True)),
                *(F.least(n, f"__{n}").alias(n) for n in least),
            )
        )
    raise CycleError("parent links form a cycle")


def paths(starts: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """The rows of starts (node and any other columns) for every node from theirs up to the root, with at and distance (from 0); work is in proportion to these rows."""
    # every round reads them
    out = checkpointed(starts.withColumns({"at": F.col("node"), "distance": F.lit(0).cast("long")}))
    for i, jump in enumerate(jumps):
        # out covers the distances below 2 ** i
        far = out.join(jump.withColumnRenamed("node", "at"), "at")
        out = out.unionByName(checkpointed(far.select(*starts.columns, F.col("up").alias("at"), (F.col("distance") + 2**i).alias("distance"))))
    return out


def ancestors(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """node, ancestor, distance (1 and up) for all pairs, which long chains make many; climbed() and paths() do with fewer."""
    _, jumps = climbed(nodes, parent)
    return paths(nodes.select(F.col("id").alias("node")), jumps).where("distance > 0").select("node", F.col("at").alias("ancestor"), "distance")
