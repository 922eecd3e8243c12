"""Reply chains: items become threads and conversations.

items: id, text, created_at, parent_id, reply_user_id, account_id, source, ord. The
order of rows matters to several rules, so it is a column (ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.closure import climbed, heights, nearest, paths, present_edges, roots
from skein.operators.ranks import ranked

#: Sources whose items may form threads of their owner; the source of items fetched for context.
OWN, FETCHED = ("twitter:tweet", "bluesky:post"), "bluesky:fetched"


def latest_by_id(items: DataFrame) -> DataFrame:
    """The last row of each non-empty id wins and takes the place of the first one; small integer ids come first, in order."""
    w = Window.partitionBy("id").orderBy(F.desc("ord"))
    out = items.where(F.coalesce("id", F.lit("")) != "").withColumn("__n", F.row_number().over(w)).withColumn("__first", F.min("ord").over(Window.partitionBy("id")))
    whole = F.col("id").rlike("^(0|[1-9][0-9]{0,9})$")
    small = whole & (F.when(whole, F.col("id").cast("long")) < 2**32 - 1)
    out = out.where("__n = 1").withColumn("__small", F.when(small, F.col("id").cast("long")))
    # the small ids' rank comes before every first place: negative, in their order
    return out.withColumn("ord", F.when(F.col("__small").isNotNull(), F.col("__small") - 2**33).otherwise(F.col("__first"))).drop("__n", "__first", "__small")


def filtered(items: DataFrame, since: str | None = None, until: str | None = None, exclude_retweets: bool = False, min_length: int = 0, with_media: bool = False) -> DataFrame:
    """Bounds are inclusive, a date alone is its first moment; a time that can't be read fails any bound. Fetched context passes every filter."""
    from skein.functions import text, times

    keep: Column = F.lit(True)
    at = times.parse(F.col("created_at"))
    for bound, ok in ((since, lambda b: at >= b), (until, lambda b: at <= b)):
        if bound is not None:
            keep &= F.coalesce(ok(times.parse(F.lit(bound))), F.lit(False))
    if exclude_retweets:
        keep &= ~text.is_retweet(F.col("text"))
    keep &= text.long_enough(F.col("text"), min_length)
    if with_media:
        keep &= F.coalesce(F.size("media"), F.lit(0)) > 0
    return items.where((F.col("source") == FETCHED) | keep)


def chain_heads(items: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """chain_id (the start's id), start_ord, root_id, n (items up to the root), kind, a row for each chain; and the jumps along the links.

    An item starts a chain unless it was fetched or a descendant that wasn't comes
    before it. A chain is a thread if all its items are its owner's.
    """
    known = items.select(F.col("id").alias("parent_id"), F.lit(True).alias("__there"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    same = ~(filled("account_id") & filled("reply_user_id")) | (F.col("account_id") == F.col("reply_user_id"))
    own = F.coalesce(F.col("source").isin(*OWN), F.lit(False)) & (F.col("__there").isNull() | same)
    placed = items.select("id", "parent_id", "ord", "source", "account_id", "reply_user_id").join(known, "parent_id", "left")
    walked, jumps = climbed(placed, anywhere={"foreign": ~own}, least={"earliest": F.when(F.col("source") != FETCHED, F.col("ord"))})
    starts = items.where(F.col("source") != FETCHED).select(F.col("id").alias("node"), F.col("ord").alias("start_ord"))
    heads = starts.join(walked, "node").where(F.coalesce(F.col("earliest") >= F.col("start_ord"), F.lit(True)))
    kind = F.when(F.col("foreign"), "conversation").otherwise("thread")
    return heads.select(F.col("node").alias("chain_id"), "start_ord", F.col("root").alias("root_id"), (F.col("depth") + 1).alias("n"), kind.alias("kind")), jumps


def longest_heads(heads: DataFrame) -> DataFrame:
    """Of the conversations with one root the longest stays, the first among equals; threads stay as they are."""
    w = Window.partitionBy("root_id", "kind").orderBy(F.desc("n"), "start_ord", "chain_id")
    return heads.withColumn("__i", F.row_number().over(w)).where("kind = 'thread' or __i = 1").drop("__i")


def chains(items: DataFrame, longest: bool = False) -> DataFrame:
    """chain_id, start_ord, root_id, pos (from 0 at the root), kind and the item's columns, a row for each item of each chain.

    With longest, chains that longest_heads drops aren't built: without it, a long
    chain whose root comes first is there once for each of its items.
    """
    heads, jumps = chain_heads(items)
    if longest:
        heads = longest_heads(heads)
    rows = paths(heads.withColumn("node", F.col("chain_id")), jumps)
    rows = rows.select(F.col("at").alias("id"), "chain_id", "start_ord", "root_id", "kind", (F.col("n") - 1 - F.col("distance")).alias("pos"))
    return rows.join(items, "id")


def longest_per_root(chained: DataFrame) -> DataFrame:
    """longest_heads for chains that are built already."""
    heads = chained.groupBy("chain_id", "root_id", "start_ord", "kind").agg(F.count("*").alias("n"))
    return chained.join(longest_heads(heads).select("chain_id"), "chain_id", "left_semi")


def thread_components(tweets: DataFrame) -> DataFrame:
    """id, component, depth: an absent parent counts as a node of its own, so that siblings under it stay together; a component is named by its earliest root."""
    known = tweets.select(F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    placed = tweets.join(known, "parent_id", "left")
    outside = placed.where(F.col("there").isNull() & F.col("parent_id").isNotNull()).select(F.concat(F.lit("ext:"), "parent_id").alias("id")).distinct()
    up = F.when(F.col("there"), F.col("parent_id")).when(F.col("parent_id").isNotNull(), F.concat(F.lit("ext:"), "parent_id"))
    nodes = placed.select("id", up.alias("up")).unionByName(outside.withColumn("up", F.lit(None).cast("string")))
    found = roots(nodes, "up").join(tweets.select(F.col("id").alias("node"), "created_at", "parent_id"), "node")
    first = found.where(F.col("depth") <= F.when(F.col("root").startswith("ext:"), 1).otherwise(0)).groupBy("root").agg(F.min_by("node", F.struct("created_at", "node")).alias("component"))
    depth = F.col("depth") - F.when(F.col("root").startswith("ext:"), 1).otherwise(0)
    return found.join(first, "root").select(F.col("node").alias("id"), "component", depth.alias("depth"), "created_at")


def branched_turns(nodes: DataFrame, group: str) -> DataFrame:
    """group, branched: children of parents (no parent being one of them) that have several."""
    per = nodes.groupBy(group, "parent_id").agg(F.count("*").alias("n"))
    return per.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("branched"))


def nearest_kept_ancestor(nodes: DataFrame, kept: Column) -> DataFrame:
    """node, ancestor: the closest ancestor for which kept holds, null where there is none."""
    return nearest(nodes, kept)


def depth_below(nodes: DataFrame) -> DataFrame:
    """node, below: how far its deepest descendant lies."""
    return heights(nodes)


def only_threads(chained: DataFrame) -> DataFrame:
    """Conversations go, as heads or with their items; what isn't in a chain is no thread either."""
    return chained.where("kind = 'thread'")


def parents_first(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """The nodes with place: parents come before their children, equals in the given order. Places are numbered within a depth."""
    depth = roots(nodes).select(F.col("node").alias("id"), "depth")
    placed = ranked(nodes.join(depth, "id"), ["depth", order, "id"], "__rank")
    first = placed.groupBy("depth").agg(F.min("__rank").alias("__first"))
    return placed.join(first, "depth").withColumn("place", (F.col("__rank") - F.col("__first") + 1).cast("long")).drop("__rank", "__first")


def source_order(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """node, earliest, depth: sorted by these two, nodes stand in the given order, each after its ancestors: those that the next one needs come right before it, root first."""
    walked, _ = climbed(nodes, least={"earliest": F.col(order)})
    return walked.select("node", "earliest", "depth")


def best_children(nodes: DataFrame, board: DataFrame) -> DataFrame:
    """parent_id, child, rule: of the children of a parent (null: of the roots) the one that a reader follows.

    The only one; else by times selected, rank, depth below it and id, where siblings
    have selections; by rank, depth and id where they have scores; else by depth and
    id. board: id, selected, rank (null without a score).
    """
    up = present_edges(nodes).select(F.col("node").alias("id"), "parent")
    rows = nodes.select("id").join(up, "id", "left").join(heights(nodes).withColumnRenamed("node", "id"), "id").join(board.select("id", "selected", "rank"), "id", "left")
    # without selections, or scores, all siblings are equal in them
    key = F.struct((-F.coalesce("selected", F.lit(0))).alias("s"), F.coalesce("rank", F.lit(2**62)).alias("r"), (-F.col("below")).alias("b"), "id")
    best = rows.groupBy("parent").agg(F.min(key).alias("k"), F.count("*").alias("n"), F.max(F.coalesce("selected", F.lit(0))).alias("s"), F.count("rank").alias("scored"))
    rule = F.when(F.col("n") == 1, "only").when(F.col("s") > 0, "selection").when(F.col("scored") > 0, "score").otherwise("longest")
    return best.select(F.col("parent").alias("parent_id"), F.col("k.id").alias("child"), rule.alias("rule"))


def main_path(nodes: DataFrame, board: DataFrame) -> DataFrame:
    """pos, id: from the best root on, best child by best child, by jumps along the best links only."""
    best = best_children(nodes, board)
    links = best.where("parent_id is not null").select(F.col("child").alias("id"), "parent_id")
    walk = roots(nodes.select("id").join(links, "id", "left"))
    start = best.where("parent_id is null").select(F.col("child").alias("root"))
    return walk.join(start, "root").select(F.col("depth").alias("pos"), F.col("node").alias("id"))
