"""Decision records folded to one row for each id.

records: id, status, tags (array), notes, ts (timestamp or null), by, ord.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("unread", "export", "skip")


def known_status(status: Column, allowed: Sequence[str] = STATUSES) -> Column:
    return F.when(status.isin(*allowed), status)


def status_rank(status: Column) -> Column:
    return F.when(status == "export", 2).when(status == "skip", 0).otherwise(1)


def applied(records: DataFrame) -> DataFrame:
    """Adds applied: a record counts if it is its id's first or no earlier than all before it; an absent time is earlier than any."""
    before = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    latest, first = F.max("ts").over(before), F.count("*").over(before) == 0
    return records.withColumn("applied", first | latest.isNull() | F.coalesce(F.col("ts") >= latest, F.lit(False)))


def fold(records: DataFrame) -> DataFrame:
    """id, status, notes, by, ts: each the last that isn't null among applied records; tags: all, in order of appearance."""
    rows = applied(records)
    last = lambda c: F.max_by(c, F.when(F.col("applied") & F.col(c).isNotNull(), F.col("ord"))).alias(c)
    tags = F.array_sort(F.collect_list(F.when(F.col("tags").isNotNull(), F.struct("ord", "tags"))))
    tags = F.array_distinct(F.flatten(F.transform(tags, lambda t: t["tags"])))
    return rows.groupBy("id").agg(last("status"), last("notes"), last("by"), last("ts"), tags.alias("tags"))


def applied_to(items: DataFrame, folded: DataFrame) -> DataFrame:
    """Items with their status, unread unless decided."""
    return items.join(folded.select("id", F.col("status").alias("__s")), "id", "left").withColumn("status", F.coalesce("__s", F.lit("unread"))).drop("__s")


def selected(items: DataFrame, folded: DataFrame) -> DataFrame:
    return items.join(folded.where("status = 'export'").select("id"), "id", "left_semi")


def summary(folded: DataFrame) -> DataFrame:
    return folded.groupBy(F.coalesce("status", F.lit("unread")).alias("status")).agg(F.count("*").alias("n"))


def from_ids(ids: DataFrame, status: str, ts: Column) -> DataFrame:
    return ids.select("id", F.lit(status).alias("status"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("notes"), ts.alias("ts"), F.lit(None).cast("string").alias("by"))
