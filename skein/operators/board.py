"""What the annotations of a log say: scores, selections and the rest.

Kinds of a log's format are parameters (annotation, tombstone): their namespace is the
log's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def annotations(events: DataFrame, annotation: str) -> DataFrame:
    """id, state, label, value, chosen, targets, parents, actor, at, text of every unsuppressed annotation. events: eligible ones (operators.log).

    state is score (label score with a number), selection (label selection with an array
    chosen), ignored (one of these labels, malformed) or generic. A selection's targets
    are what was shown, or else its parents; others' are their parents.
    """
    p = F.col("__p")
    rows = events.where((F.col("kind") == annotation) & ~F.col("suppressed")).withColumn("__p", F.try_parse_json("payload"))
    get = lambda name: F.try_variant_get(p, f"$.{name}", "variant")
    label = F.when(F.schema_of_variant(get("label")) == "STRING", F.try_variant_get(p, "$.label", "string"))
    numeric = F.coalesce(F.schema_of_variant(get("value")).rlike(_NUMBER), F.lit(False))

    def strings(name: str) -> Column:
        parts = F.try_variant_get(p, f"$.{name}", "array<variant>")
        return F.array_distinct(F.transform(F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string")))

    rows = rows.select("id", label.alias("label"), numeric.alias("numeric"), F.try_variant_get(p, "$.value", "double").alias("value"), strings("chosen").alias("chosen"), strings("shown").alias("shown"), "parents", "actor", "at", "text")
    scored, selected = F.coalesce(F.col("label") == "score", F.lit(False)), F.coalesce(F.col("label") == "selection", F.lit(False))
    state = F.when(scored & F.col("numeric"), "score").when(selected & F.col("chosen").isNotNull(), "selection").when(scored | selected, "ignored").otherwise("generic")
    targets = F.when((state == "selection") & (F.coalesce(F.size("shown"), F.lit(0)) > 0), F.col("shown")).otherwise(F.array_distinct("parents"))
    return rows.select("id", state.alias("state"), "label", F.when(state == "score", F.col("value")).alias("value"), "chosen", targets.alias("targets"), "parents", "actor", "at", "text")


def scores(notes: DataFrame) -> DataFrame:
    """target, annotation, value."""
    return notes.where("state = 'score'").select(F.explode("targets").alias("target"), F.col("id").alias("annotation"), "value")


def selections(notes: DataFrame) -> DataFrame:
    """id, chosen, shown."""
    return notes.where("state = 'selection'").select("id", "chosen", F.col("targets").alias("shown"))


def is_content(annotation: str, tombstone: str) -> Column:
    """Whether an event stands on a thread: annotations, tombstones and critical events attach to one."""
    return ~(F.col("kind").isin(annotation, tombstone) | F.col("critical")) | F.col("kind").isNull() & ~F.col("critical")
