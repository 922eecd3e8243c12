"""Messages: adjacent turns of a role are merged, by gaps and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def role_of(source: Column, has_full_text: Column) -> Column:
    return F.when(has_full_text | (source == "bluesky:post"), "assistant").otherwise("user")


def islands(turns: DataFrame, group: Sequence[str], order: Sequence[str], role: str = "role") -> DataFrame:
    """Adds island: numbers runs of one role in a group, from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    change = F.when(F.lag(role).over(w) == F.col(role), 0).otherwise(1)
    return turns.withColumn("__change", change).withColumn("island", (F.sum("__change").over(w) - 1).cast("long")).drop("__change")


def merged(turns: DataFrame, group: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """group, island, role, content: empty texts go first, then runs of a role are joined by an empty line."""
    kept = turns.where(F.coalesce(text, F.lit("")) != "")
    runs = islands(kept, group, order).groupBy(*group, "island", "role")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return runs.agg(F.array_join(F.transform(parts, lambda p: p["__text"]), "\n\n").alias("content"))


def to_last_assistant(messages: DataFrame, group: Sequence[str]) -> DataFrame:
    """What follows the last assistant message goes; a group without one goes whole."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("island"))).over(Window.partitionBy(*group))
    return messages.withColumn("__last", last).where(F.col("island") <= F.col("__last")).drop("__last")


def segments(posts: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each assistant run with the user run before it becomes a conversation of two; a leading assistant run and a trailing user run go."""
    runs = merged(posts, group, order)
    w = Window.partitionBy(*group).orderBy("island")
    paired = runs.withColumn("user_text", F.lag("content").over(w))
    out = paired.where((F.col("role") == "assistant") & F.col("user_text").isNotNull())
    return out.withColumn("segment", (F.row_number().over(w) - 1).cast("long")).select(*group, "segment", "user_text", F.col("content").alias("assistant_text"))


def unique_characters(posts: DataFrame) -> DataFrame:
    """key (handle, display name or author), posts, display, author, first_ord: most posts first, then first seen."""
    key = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("handle"), F.col("display"), F.col("author"))))
    named = posts.withColumn("key", key).where(F.col("key").isNotNull())
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    return named.groupBy("key").agg(F.count("*").alias("posts"), first("display"), first("author"), F.min("ord").alias("first_ord"))


def character_expansion(posts: DataFrame, characters: DataFrame, group: Sequence[str], order: Sequence[str], least: int = 10) -> DataFrame:
    """For each character with enough posts, the segments in which it is the assistant. A character meets the groups that it posts in, and no others."""
    cast = characters.where(F.col("posts") >= least).select("key")
    mine = F.lower(F.coalesce("handle", F.lit(""))) == F.lower("key")
    mine |= F.lower(F.coalesce("display", F.lit(""))) == F.lower("key")
    seen = posts.select(*group, F.explode(F.array_distinct(F.filter(F.array("handle", "display"), lambda x: x.isNotNull()))).alias("key")).distinct().join(cast, "key", "left_semi")
    turns = seen.join(posts, list(group)).withColumn("role", F.when(mine, "assistant").otherwise("user"))
    return segments(turns, ["key", *group], order)


def role_matches(who: str, fields: Sequence[str] = ("display", "handle"), pattern: bool = False) -> Column:
    """Whether a post is by who: some field is that name, in any case, or (pattern) holds a match of it; null fields never do."""
    one = lambda c: F.col(c).rlike(f"(?i){who}") if pattern else F.lower(c) == who.lower()
    return F.greatest(F.lit(False), *(F.coalesce(one(c), F.lit(False)) for c in fields))


def sharegpt(messages: DataFrame) -> DataFrame:
    return messages.withColumn("from", F.when(F.col("role") == "user", "human").otherwise("gpt")).withColumnRenamed("content", "value")
