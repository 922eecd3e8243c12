"""Items, threads and scores as events of a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import ids, times

#: The fields that may name an item's author, in this order.
ACTOR_FIELDS = ("character_display_name", "character_handle", "author", "screen_name", "username", "handle", "accountId")


def kind_of(source: Column) -> Column:
    """a:b becomes a/b, a bare a becomes a/item."""
    return F.when(F.contains(source, F.lit(":")), F.regexp_replace(source, "^([^:]*):", "$1/")).otherwise(F.concat(source, F.lit("/item")))


def namespace_of(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def actor_of(raw: Column) -> Column:
    """The first field of a variant's ACTOR_FIELDS that isn't blank, else unknown."""
    fields = (F.try_variant_get(raw, f"$.{name}", "string") for name in ACTOR_FIELDS)
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in fields), F.lit("unknown"))


def item_events(items: DataFrame, fallback: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """id, kind, at, rule, actor, parents, skip, ord: an event for each item (id, source, created_at, parent_id, raw, ord).

    A parent is named by its hashed id whether it is there or not. An item without an id
    has skip set and is no event.
    """
    own = namespace_of(F.col("source"))
    name = lambda c: ids.event_id(own, F.lit("item"), F.col(c))
    skip = F.when(F.coalesce("id", F.lit("")) == "", "no id")
    out = items.withColumn("__t", times.normalised(F.col("created_at"), F.lit(fallback)))
    parents = F.when(F.col("parent_id").isNotNull(), F.array(name("parent_id"))).otherwise(F.array().cast("array<string>"))
    return out.select(F.when(skip.isNull(), name("id")).alias("id"), kind_of(F.col("source")).alias("kind"), F.col("__t.at").alias("at"), F.col("__t.rule").alias("rule"), actor_of(F.col("raw")).alias("actor"), parents.alias("parents"), skip.alias("skip"), "ord")


def chained(events: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Events of a thread: parents is that of the event itself, or else the event before it."""
    before = F.lag("id").over(Window.partitionBy(*group).orderBy(*order))
    linear = F.when(before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<string>"))
    return events.withColumn("parents", F.when(F.coalesce(F.size("parents"), F.lit(0)) > 0, F.col("parents")).otherwise(linear))


def artifact_text(payload: Column) -> Column:
    """The text of a payload (a variant): text, a message that is a string, the message's text, its content, its blocks' texts; null where there is none."""
    get = lambda p: F.when(F.schema_of_variant(F.try_variant_get(payload, p, "variant")) == "STRING", F.try_variant_get(payload, p, "string"))
    blocks = F.try_variant_get(payload, "$.message.content", "array<variant>")
    texts = F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.coalesce(get("$.text"), get("$.message"), get("$.message.text"), get("$.message.content"), F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")))


def message_rows(segments: Column, completion: Column) -> Column:
    """Segments and a completion, each (actor, text), as messages: who speaks like the completion is the assistant."""
    role = lambda s: F.when(s["actor"].eqNullSafe(completion["actor"]), "assistant").otherwise("user")
    return F.transform(F.concat(segments, F.array(completion)), lambda s: F.struct(role(s).alias("role"), s["text"].alias("content")))


def score_rows(trajectories: DataFrame) -> DataFrame:
    """candidate, key, score: seed::witness for each witness that has a value, else the seed with the score. trajectories: candidate, seed, score, witnesses (map)."""
    some = F.coalesce(F.size(F.nullif(F.map_keys("witnesses"), F.array().cast("array<string>"))), F.lit(0)) > 0
    per = trajectories.where(some).select("candidate", "seed", F.explode("witnesses").alias("w", "value")).select("candidate", F.concat_ws("::", "seed", "w").alias("key"), F.col("value").alias("score"))
    return per.unionByName(trajectories.where(~F.coalesce(some, F.lit(False))).select("candidate", F.col("seed").alias("key"), "score"))
