"""Conversations as looms: one snapshot of turns for each, in JSON, and the check of what was written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.chains import nearest_kept_ancestor, source_order, thread_components
from skein.operators.closure import roots
from skein.operators.ranks import ranked

#: The profile of a conversation's snapshot; session events whose kind starts so are its turns.
PROFILE, TURN_KINDS = "conversation", "claude/"

_SNAPSHOT = "struct<loom:struct<id:string,meta:struct<profile:string>>,turns:array<struct<id:string,parentId:string>>>"


def is_turn(kind: Column) -> Column:
    return F.coalesce(F.startswith(kind, F.lit(TURN_KINDS)), F.lit(False))


def turns(rows: DataFrame) -> DataFrame:
    """The rows (loom, id, parent_id, ord and others) with place, from 0 in each loom; ids are unique over all looms.

    A parent that is no row of its loom is none. Places are the reader's: rows go in the
    order of ord, but no row comes before its parent. Cycles raise.
    """
    up = rows.select(F.col("id").alias("parent_id"), F.col("loom").alias("__loom"))
    rows = rows.join(up, "parent_id", "left").withColumn("parent_id", F.when(F.col("__loom").eqNullSafe(F.col("loom")), F.col("parent_id"))).drop("__loom")
    placed = rows.join(source_order(rows.select("id", "parent_id", "ord")).withColumnRenamed("node", "id"), "id")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("loom").orderBy("earliest", "depth", "id")) - 1).drop("earliest", "depth")


def session_turns(events: DataFrame) -> DataFrame:
    """turns() of a session's events (loom, id, kind, parents, ord and others): the first parent counts."""
    rows = events.where(is_turn(F.col("kind"))).withColumn("parent_id", F.try_element_at("parents", F.lit(1))).drop("parents")
    return turns(rows)


def other_kinds(events: DataFrame) -> DataFrame:
    """loom, kind, n: the events of a session that are no turns."""
    return events.where(~is_turn(F.col("kind"))).groupBy("loom", "kind").agg(F.count("*").alias("n"))


def export_turns(messages: DataFrame) -> DataFrame:
    """turns() of a chat export without placeholders (sources.exports.read_claude_export): loom is the conversation's number and id, so that ids of messages may repeat between conversations; the author is the model, else the role. Rows with skip, and messages whose id is null, are no turns."""
    good = messages.where("skip is null and id is not null")
    loom = F.concat_ws(":", F.col("conv_ord").cast("string"), "conv")
    named = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", loom, c))
    rows = good.select(loom.alias("loom"), named("id").alias("id"), named("parent_id").alias("parent_id"), F.col("ord").cast("long").alias("ord"), "role", F.coalesce("model", "role", F.lit("unknown")).alias("author"), "text")
    return turns(rows)


def mapping_turns(nodes: DataFrame) -> DataFrame:
    """turns() of a chat export whose nodes may be placeholders (sources.exports.read_chatgpt_export): a turn's parent is the nearest node above it that holds a message. Nodes stand in the order of the tree, siblings by id."""
    good = nodes.where("skip is null and id is not null")
    loom = F.concat_ws(":", F.col("conv_ord").cast("string"), "conv")
    named = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", loom, c))
    rows = good.select(loom.alias("loom"), named("id").alias("id"), named("parent_id").alias("parent_id"), "has_message", "role", F.coalesce("model", "role", F.lit("unknown")).alias("author"), "text")
    above = nearest_kept_ancestor(rows, F.col("has_message")).select(F.col("node").alias("id"), F.col("ancestor").alias("__above"))
    kept = rows.where("has_message").join(above, "id").withColumn("parent_id", F.col("__above")).drop("__above", "has_message")
    depth = roots(kept.select("id", "parent_id")).select(F.col("node").alias("id"), F.col("depth").alias("ord"))
    return turns(kept.join(depth, "id"))


def thread_turns(posts: DataFrame, owner: str, author: str | None = None) -> DataFrame:
    """turns() of posts (id, parent_id, created_at, handle, text): a loom for each thread (chains.thread_components), which is named by its earliest root. The owner's posts are the user's, by author or else the handle; a post without handle is the owner's."""
    found = thread_components(posts.select("id", "parent_id", "created_at")).select("id", F.col("component").alias("loom"))
    handle = F.coalesce("handle", F.lit(owner))
    role = role_of(handle, F.lit(owner))
    rows = posts.select("id", "parent_id", "created_at", "text", role.alias("role"), F.when(role == "user", F.lit(author or owner)).otherwise(handle).alias("author"))
    placed = ranked(rows.join(found, "id"), ["created_at", "id"], "ord")
    return turns(placed.drop("created_at"))


def folded(events: DataFrame, loom_kind: str, turn_kind: str) -> DataFrame:
    """turns() of a log's loom events: id, loom (the loom event above it), parent_id (the first parent that is a turn), text, role, author from the turn's own payload and meta. events: eligible ones, with payload (JSON); other kinds and suppressed turns take no part."""
    rows = events.where(F.col("kind").isin(loom_kind, turn_kind)).withColumn("p", F.try_parse_json("payload"))
    rows = rows.select("id", "kind", "suppressed", "file", "line", F.try_element_at("parents", F.lit(1)).alias("parent_id"), *(F.try_variant_get("p", f"$.{at}", "string").alias(n) for n, at in (("text", "payload.text"), ("role", "meta.role"), ("author", "meta.author"))))
    top = roots(rows.select("id", "parent_id")).select(F.col("node").alias("id"), F.col("root").alias("loom"))
    placed = rows.where((F.col("kind") == turn_kind) & ~F.col("suppressed")).join(top, "id")
    return turns(ranked(placed, ["file", "line"], "ord").drop("kind", "suppressed", "file", "line"))


def role_of(handle: Column, owner: Column) -> Column:
    """The owner of a thread speaks as the user, everyone else as the assistant."""
    return F.when(F.lower(handle) == F.lower(owner), "user").otherwise("assistant")


def snapshots(placed: DataFrame, meta: Mapping[str, str]) -> DataFrame:
    """loom, turns (their number), value: the snapshot as JSON. placed: turns with role, author and text; a null text is null in it."""
    turn = F.struct("place", F.col("id"), F.col("parent_id").alias("parentId"), F.struct("text").alias("payload"), F.struct("role", "author").alias("meta"))
    per = placed.groupBy("loom").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(turn)).alias("t"))
    head = F.struct(F.col("loom").cast("string").alias("id"), F.struct(F.lit(PROFILE).alias("profile"), *(F.lit(v).alias(k) for k, v in meta.items())).alias("meta"))
    body = F.transform("t", lambda t: t.dropFields("place"))
    return per.select("loom", "turns", F.to_json(F.struct(head.alias("loom"), body.alias("turns")), {"ignoreNullFields": "false"}).alias("value"))


def file_names(written: DataFrame, kind: str) -> DataFrame:
    """written with name: kind, the loom's number by id and the id."""
    numbered = ranked(written, ["loom"], "__number")
    return numbered.withColumn("name", F.format_string(f"{kind}-%04d-%s.json", "__number", F.regexp_replace(F.col("loom").cast("string"), "[^A-Za-z0-9_-]", "_"))).drop("__number")


def verify(written: DataFrame) -> DataFrame:
    """loom, profile, turns, problems (empty where the snapshot is whole), read back from snapshots (loom, turns, value).

    Checked are the JSON, the profile, the number of turns, that ids are unique and that each parent comes before its children.
    """
    read = written.select("loom", F.col("turns").alias("told"), F.from_json("value", _SNAPSHOT).alias("s"))
    rows = read.select("loom", F.posexplode("s.turns").alias("place", "t")).select("loom", "place", F.col("t.id").alias("id"), F.col("t.parentId").alias("parent"))
    first = rows.groupBy("loom", "id").agg(F.min("place").alias("at"), F.count("*").alias("n"))
    again = first.groupBy("loom").agg(F.sum((F.col("n") > 1).cast("long")).alias("again"))
    up = rows.where("parent is not null").join(first.select("loom", F.col("id").alias("parent"), "at"), ["loom", "parent"], "left")
    loose = up.groupBy("loom").agg(F.sum((F.col("at").isNull() | (F.col("at") >= F.col("place"))).cast("long")).alias("loose"))
    out = read.join(again, "loom", "left").join(loose, "loom", "left")
    number, profile = F.coalesce(F.size("s.turns"), F.lit(-1)), F.col("s.loom.meta.profile")
    problems = [(F.col("s.loom").isNull(), "no snapshot"), (~profile.eqNullSafe(F.lit(PROFILE)), "profile"), (number != F.col("told"), "number of turns"), (F.coalesce("again", F.lit(0)) > 0, "ids twice"), (F.coalesce("loose", F.lit(0)) > 0, "parents that don't come before")]
    return out.select("loom", profile.alias("profile"), number.cast("long").alias("turns"), F.concat_ws(", ", *(F.when(bad, name) for bad, name in problems)).alias("problems"))


def verified(written: DataFrame) -> DataFrame:
    """verify(), which raises where a snapshot has a problem."""
    out = verify(written)
    bad = out.where("problems != ''").limit(1).collect()
    if bad:
        raise ValueError(f"loom {bad[0]['loom']}: {bad[0]['problems']}")
    return out
