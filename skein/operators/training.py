"""Scores and selections over an event log become fine-tuning rows and preference pairs.

events: id, parent (the first one), parents, text, suppressed, actor. scores: target,
annotation, value. selections: id, chosen (array), shown (array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.closure import climbed, paths
from skein.operators.ranks import ranked


def pinned_mean(values: Column) -> Column:
    """Mean of an array of (annotation, value), summed in the order of the annotations' ids."""
    ordered = F.array_sort(values)
    return F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x["value"]) / F.nullif(F.size(ordered), F.lit(0))


def leaderboard(scores: DataFrame, selections: DataFrame) -> DataFrame:
    """target, score_count, mean, selection_count, selected_count, rank: mean first, then times selected, then id."""
    s = scores.groupBy("target").agg(F.count("*").alias("score_count"), pinned_mean(F.collect_list(F.struct("annotation", "value"))).alias("mean"))
    shown = selections.select(F.explode("shown").alias("target"), "chosen")
    c = shown.groupBy("target").agg(F.count("*").alias("selection_count"), F.sum(F.array_contains("chosen", F.col("target")).cast("long")).alias("selected_count"))
    both = s.join(c, "target", "full_outer").fillna(0, ["score_count", "selection_count", "selected_count"])
    return ranked(both, [F.desc_nulls_last("mean"), F.desc("selected_count"), "target"])


def context_faults(events: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """id and what is wrong on the way to the root: partial (also of the event itself), suppressed_context, no_train_context; and the jumps along the links."""
    nodes = events.select("id", F.col("parent").alias("parent_id"), "suppressed", "marked")
    known = events.select(F.col("id").alias("parent_id"), F.lit(True).alias("__there"))
    cut = F.col("parent_id").isNotNull() & F.col("__there").isNull()
    walked, jumps = climbed(nodes.join(known, "parent_id", "left"), anywhere={"suppressed_context": F.col("suppressed"), "no_train_context": F.col("marked"), "partial": cut})
    above = walked.select(F.col("node").alias("parent_id"), "suppressed_context", "no_train_context")
    found = walked.select(F.col("node").alias("id"), "partial").join(nodes.select("id", "parent_id"), "id").join(above, "parent_id", "left")
    no = F.lit(False)
    return found.select("id", F.coalesce("suppressed_context", no).alias("suppressed_context"), F.coalesce("no_train_context", no).alias("no_train_context"), "partial"), jumps


def contexts(events: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """id, segments, and what context_faults finds; of all events, or of those whose id is in wanted.

    Segments are the texts of unsuppressed ancestors, root first. Work is in proportion
    to the events and to the ways of the wanted ones; a wanted event with a fault is no
    training row and has no segments, unless all are asked for.
    """
    faults, jumps = context_faults(events)
    if wanted is not None:
        faults = faults.join(wanted.select("id").distinct(), "id", "left_semi")
    asked = faults if wanted is None else faults.where("not (partial or suppressed_context or no_train_context)")
    path = paths(asked.select(F.col("id").alias("node")), jumps).where("distance > 0")
    texts = events.where("text is not null and not suppressed").select(F.col("id").alias("at"), "text")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "text")))
    per = path.join(texts, "at").groupBy(F.col("node").alias("id")).agg(F.transform(ordered, lambda t: t["text"]).alias("segments"))
    return faults.join(per, "id", "left").withColumn("segments", F.coalesce("segments", F.array().cast("array<string>")))


def candidates(events: DataFrame, board: DataFrame) -> DataFrame:
    """id: scored or selected events that pass the gates of their own."""
    return _passing(events).join(board.where("score_count > 0 or selected_count > 0").select(F.col("target").alias("id")), "id", "left_semi")


def chosen(events: DataFrame, selections: DataFrame) -> DataFrame:
    """id: chosen events that pass the gates of their own."""
    return _passing(events).join(selections.select(F.explode("chosen").alias("id")), "id", "left_semi")


def _passing(events: DataFrame) -> DataFrame:
    return events.where("text is not null and not suppressed and not marked").select("id")


def sft(events: DataFrame, board: DataFrame, context: DataFrame) -> DataFrame:
    """target, weight, skip: the first gate that fails names the skip; rows without one are training rows. context: contexts(), or context_faults() where no segments are needed."""
    named = board.where("score_count > 0 or selected_count > 0").select("target", "mean")
    rows = named.join(events.withColumnRenamed("id", "target"), "target", "left").join(context.withColumnRenamed("id", "target"), "target", "left")
    gates = [("ineligible", F.col("suppressed").isNull()), ("suppressed-completion", F.col("suppressed")), ("no-text", F.col("text").isNull()), ("no-train", F.col("marked")), ("partial", F.col("partial")), ("suppressed-context", F.col("suppressed_context")), ("no-train-context", F.col("no_train_context"))]
    skip = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        skip = F.when(fails, name).otherwise(skip)
    return rows.select("target", F.col("mean").alias("weight"), skip.alias("skip"), "text", *_segments(context), "actor")


def _segments(context: DataFrame) -> list[str]:
    return [c for c in ("segments",) if c in context.columns]


def preferences(events: DataFrame, selections: DataFrame, context: DataFrame) -> DataFrame:
    """selection, chosen, rejected, skip: each chosen one against each that was shown and not chosen."""
    pairs = selections.select(F.col("id").alias("selection"), F.explode("chosen").alias("chosen"), F.array_except("shown", "chosen").alias("others")).select("selection", "chosen", F.explode("others").alias("rejected"))
    for side in ("chosen", "rejected"):
        e = events.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("parent", "text", "suppressed", "marked")))
        pairs = pairs.join(e, side, "left")
    pairs = pairs.join(context.withColumnRenamed("id", "chosen"), "chosen", "left")
    any_ = lambda c: F.col(f"chosen_{c}") | F.col(f"rejected_{c}")
    gates = [
        ("ineligible", F.col("chosen_suppressed").isNull() | F.col("rejected_suppressed").isNull()),
        ("suppressed", any_("suppressed")),
        ("no-text", F.col("chosen_text").isNull() | F.col("rejected_text").isNull()),
        ("no-train", any_("marked")),
        ("different-parent", ~F.col("chosen_parent").eqNullSafe(F.col("rejected_parent"))),
        ("partial", F.col("partial")),
        ("suppressed-context", F.col("suppressed_context")),
        ("no-train-context", F.col("no_train_context")),
    ]
    skip = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        skip = F.when(fails, name).otherwise(skip)
    return pairs.select("selection", "chosen", "rejected", skip.alias("skip"), *_segments(context), "chosen_text", "rejected_text")


def plain(segments: Column, completion: Column) -> Column:
    return F.array_join(F.concat(segments, F.array(completion)), "\n\n")
