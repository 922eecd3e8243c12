"""Candidates that are best at something: the first with the top score of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def winners(scores: DataFrame) -> DataFrame:
    """key, candidate, score of each key's winner. scores: candidate, key, score, accepted, ord; a later value of a candidate and key replaces an earlier one."""
    last = Window.partitionBy("candidate", "key").orderBy(F.desc("ord"))
    kept = scores.where("accepted").withColumn("__n", F.row_number().over(last)).where("__n = 1")
    seen = kept.withColumn("__seen", F.min("ord").over(Window.partitionBy("candidate")))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "__seen", "candidate")
    return seen.withColumn("__i", F.row_number().over(best)).where("__i = 1").select("key", "candidate", "score")


def front(scores: DataFrame) -> DataFrame:
    """candidate, keys_won."""
    return winners(scores).groupBy("candidate").agg(F.count("*").alias("keys_won"))


def average(values):
    return F.coalesce(F.avg(values), F.lit(0.0))
