"""The event log as a stream: lines are united by id while they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(lines: DataFrame, delay: str = "1 day") -> DataFrame:
    """Lines with equal id and bytes once, over the state that the watermark on `at` keeps."""
    rows = lines.withColumn("body_digest", F.sha2("text", 256)).withWatermark("at", delay)
    return rows.dropDuplicatesWithinWatermark(["id", "body_digest"])


def conflicts(lines: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Ids that come with different bytes within a window of event time; update or complete mode."""
    rows = lines.withColumn("body_digest", F.sha2("text", 256)).withWatermark("at", delay)
    per = rows.groupBy(F.window("at", window), "id").agg(F.min("body_digest").alias("least"), F.max("body_digest").alias("most"), F.count("*").alias("lines"))
    return per.where("least != most").select("id", "lines", F.col("window.start").alias("from"))


def daily_counts(lines: DataFrame, delay: str = "1 day") -> DataFrame:
    """Lines by kind and day, for append mode."""
    return lines.withWatermark("at", delay).groupBy(F.window("at", "1 day"), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "kind", "n")
