"""Append-only event logs: lines are classified, then united by id.

A line is JSON with v, id, kind, at, author, parents, payload and perhaps critical,
marked and, last, digest. Classes: garbage (not a JSON object), damaged (its digest
isn't that of the line without it), nonconforming (an envelope field is missing or of
the wrong form), conflict-variant (other bytes under the same id), accepted.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import times
from skein.operators.closure import cyclic
from skein.operators.tables import checkpointed

ENVELOPE = "struct<v:int,id:string,kind:string,at:string,parents:array<string>,critical:boolean,marked:string,author:struct<actor:string>>"
#: Bytes from which a line is too long for a variant.
LONG = 16 * 1024 * 1024
_DIGEST = r',"digest":"sha256:([0-9a-f]{64})"\}$'


def classified(lines: DataFrame) -> DataFrame:
    """lines: file, line, text. Adds class, reason, id, kind, at, parents, critical, payload (JSON text), body_digest."""
    text = F.col("text")
    given = F.regexp_extract(text, _DIGEST, 1)
    body = F.when(given != "", F.concat(F.regexp_replace(text, _DIGEST, ""), F.lit("}"))).otherwise(text)
    rows = lines.withColumn("body_digest", F.sha2(body, 256)).withColumn("__given", given)
    rows = rows.withColumn("__json", F.try_parse_json(text)).withColumn("__e", F.from_json(text, ENVELOPE))
    kind = F.col("__e.kind")
    fit = (F.col("__e.v") == 1) & F.col("__e.id").isNotNull() & kind.rlike("^[^/]+/[^/]+") & times.is_rfc3339(F.col("__e.at")) & F.col("__e.parents").isNotNull()
    # of a line too long for a variant, an envelope that could be read says that it is an object
    whole = (F.octet_length(text) >= LONG) & F.col("__json").isNull() & F.col("__e.id").isNotNull()
    is_object = F.coalesce(F.schema_of_variant("__json").startswith("OBJECT"), whole, F.lit(False)) | F.coalesce(whole, F.lit(False))
    own = F.when(~is_object, "garbage").when((F.col("__given") != "") & (F.col("__given") != F.col("body_digest")), "damaged").when(F.coalesce(fit, F.lit(False)), "accepted").otherwise("nonconforming")
    payload = F.coalesce(F.to_json(F.try_variant_get("__json", "$.payload", "variant")), F.when(whole, _long_payload(text)))
    rows = rows.withColumn("class", own).select(
        "file", "line", "text", "class", F.when(F.col("class").isin("accepted", "nonconforming"), F.col("__e.id")).alias("id"), kind.alias("kind"), F.col("__e.at").alias("at"), F.col("__e.parents").alias("parents"), F.coalesce("__e.critical", F.lit(False)).alias("critical"), payload.alias("payload"), F.coalesce(F.try_variant_get("__json", "$.author.actor", "string"), F.when(whole, F.col("__e.author.actor"))).alias("actor"), "body_digest"
    )
    # parsed once, whatever is asked of the log
    rows = checkpointed(rows)
    several = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("body_digest").alias("a"), F.max("body_digest").alias("z")).where("a != z").select("id", F.lit(True).alias("__several"))
    rows = rows.join(several, "id", "left").withColumn("class", F.when(F.col("__several"), "conflict-variant").otherwise(F.col("class")))
    reason = F.when(F.col("class") == "damaged", "sha256 mismatch").when(F.col("class") == "garbage", "not a JSON object").when(F.col("class") == "conflict-variant", "other bytes under this id").when(F.col("class") == "nonconforming", "envelope")
    return rows.select("file", "line", "text", "class", reason.alias("reason"), "id", "kind", "at", "parents", "critical", "payload", "actor", "body_digest")


def _long_payload(text: Column) -> Column:
    """The payload of a line in the canonical order of keys, where it stands last but for these three; no parser takes strings so long."""
    body = F.regexp_replace(text, r'(,"critical":(true|false))?(,"marked":"[^"]*")?(,"digest":"sha256:[0-9a-f]{64}")?\}$', "")
    at = F.locate('"payload":', body)
    return F.when(at > 0, F.substr(body, at + 10))


def eligible(rows: DataFrame) -> DataFrame:
    """One row for each id that a view may show (the first line of it), with suppressed: a critical event names it as parent."""
    w = Window.partitionBy("id").orderBy("file", "line")
    first = rows.where(F.col("class").isin("accepted", "nonconforming") & F.col("id").isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    first = checkpointed(first)
    return first.join(suppressed(first), "id", "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def suppressed(events: DataFrame) -> DataFrame:
    return events.where("critical").select(F.explode("parents").alias("id")).distinct().withColumn("suppressed", F.lit(True))


def union_state(rows: DataFrame, digest: str = "body_digest") -> DataFrame:
    """id, lines, variants, state: single, duplicate (equal bytes) or conflict."""
    per = rows.groupBy("id").agg(F.count("*").alias("lines"), F.countDistinct(digest).alias("variants"))
    return per.withColumn("state", F.when(F.col("variants") > 1, "conflict").when(F.col("lines") > 1, "duplicate").otherwise("single"))


def dangling(events: DataFrame) -> DataFrame:
    """id, missing: parents that no event has."""
    return events.select("id", F.explode("parents").alias("missing")).join(events.select(F.col("id").alias("missing")), "missing", "left_anti").select("id", "missing")


def cycles(events: DataFrame) -> DataFrame:
    """id, subject of the events whose ancestry leads back to them; subject is the least id on their cycles."""
    links = events.select(F.col("id").alias("node"), F.explode(F.array_distinct("parents")).alias("parent"))
    return cyclic(links.join(events.select(F.col("id").alias("parent")), "parent", "left_semi")).select(F.col("node").alias("id"), F.col("first").alias("subject"))


def obstacles(events: DataFrame, conflicted: DataFrame) -> DataFrame:
    """what, subject, id: what ancestry stumbles over: missing and unavailable (by conflict) parents once each, and cycle with a row for each event on one.

    events: eligible ones; conflicted: id of those whose lines differ.
    """
    lost = dangling(events).select(F.col("missing").alias("subject")).distinct()
    known = conflicted.select(F.col("id").alias("subject"), F.lit(True).alias("__c")).distinct()
    lost = lost.join(known, "subject", "left").select(F.when(F.col("__c"), "unavailable").otherwise("missing").alias("what"), "subject", F.col("subject").alias("id"))
    return lost.unionByName(cycles(events).select(F.lit("cycle").alias("what"), "subject", "id"))


def tombstones(events: DataFrame) -> DataFrame:
    """target, by: the critical events that name it, in order of their ids."""
    return events.where("critical").select(F.explode("parents").alias("target"), "id").groupBy("target").agg(F.array_sort(F.collect_set("id")).alias("by"))


def branches(events: DataFrame, conflicted: DataFrame) -> DataFrame:
    """id, children (ids in order), suppressed, conflicted_parents, missing_parents, partial: some parent can't be shown.

    events: eligible ones; conflicted: id of those whose lines differ.
    """
    up = events.select("id", F.explode(F.array_distinct("parents")).alias("parent"))
    children = up.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("children"))
    there = events.select(F.col("id").alias("parent"), F.lit("there").alias("state")).unionByName(conflicted.select(F.col("id").alias("parent"), F.lit("conflict").alias("state")).distinct())
    gone = up.join(there, "parent", "left").groupBy("id").agg(F.count(F.when(F.col("state") == "conflict", 1)).alias("conflicted_parents"), F.count(F.when(F.col("state").isNull(), 1)).alias("missing_parents"))
    out = events.select("id", "suppressed").join(children, "id", "left").join(gone, "id", "left").fillna(0, ["conflicted_parents", "missing_parents"])
    return out.withColumn("children", F.coalesce("children", F.array().cast("array<string>"))).withColumn("partial", F.col("conflicted_parents") + F.col("missing_parents") > 0)


def verify_report(rows: DataFrame) -> DataFrame:
    """kind (empty where a line has none), lines, accepted, conflicts. rows: classified lines."""
    is_ = lambda c: F.count(F.when(F.col("class") == c, 1))
    return rows.groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("lines"), is_("accepted").alias("accepted"), is_("conflict-variant").alias("conflicts"))


def verified(rows: DataFrame) -> DataFrame:
    """The report of lines read back from a written file; raises unless all are accepted."""
    bad = rows.where("class != 'accepted'").select("file", "line", "class", "reason").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}:{bad[0]['line']} is {bad[0]['class']}: {bad[0]['reason']}")
    return verify_report(rows)


def diagnostics(rows: DataFrame) -> DataFrame:
    """what, subject, n: lines of each class, conflicting ids with their variants, parents that are missing or unavailable for a conflict with the references to them, cycles (by their least id) with their events, withheld ids. rows: classified lines."""
    events = eligible(rows)
    conflicts = rows.where("class = 'conflict-variant'").groupBy(F.col("id").alias("subject")).agg(F.countDistinct("body_digest").alias("n"))
    references = events.select(F.explode(F.array_distinct("parents")).alias("subject")).groupBy("subject").agg(F.count("*").alias("n"))
    lost = references.join(events.select(F.col("id").alias("subject")), "subject", "left_anti")
    parts = {
        "class": rows.groupBy(F.col("class").alias("subject")).agg(F.count("*").alias("n")),
        "conflict": conflicts,
        "missing": lost.join(conflicts, "subject", "left_anti"),
        "unavailable": lost.join(conflicts, "subject", "left_semi"),
        "cycle": cycles(events).groupBy("subject").agg(F.count("*").alias("n")),
        "withheld": events.where("suppressed").select(F.col("id").alias("subject"), F.lit(1).cast("long").alias("n")),
    }
    labelled = [df.select(F.lit(what).alias("what"), "subject", "n") for what, df in parts.items()]
    return functools.reduce(DataFrame.unionByName, labelled)


def attachments(events: DataFrame) -> DataFrame:
    """target, bucket, ids (in order): critical events that name a target (suppressors), its annotations that nothing reads (generic) and those that are malformed (ignored).

    events: id, annotation (boolean), label, parents, critical, suppressed, ignored. Scores and selections are the leaderboard's.
    """
    read = F.coalesce(F.col("label").isin("score", "selection"), F.lit(False))
    own = F.when(F.col("annotation") & ~F.col("suppressed"), F.when(F.col("ignored"), "ignored").when(~read, "generic"))
    buckets = F.array_compact(F.array(F.when(F.col("critical"), "suppressors"), own))
    named = events.select("id", F.explode("parents").alias("target"), buckets.alias("b")).select("id", "target", F.explode("b").alias("bucket"))
    return named.groupBy("target", "bucket").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def no_train(events: DataFrame) -> DataFrame:
    """id, marks: what unsuppressed no-train annotations name, and those annotations' ids in order."""
    marks = events.where((F.col("label") == "no-train") & ~F.col("suppressed"))
    return marks.select(F.explode("parents").alias("target"), "id").groupBy("target").agg(F.array_sort(F.collect_set("id")).alias("marks"))


def files_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_set("file")).alias("files"))


def reconcile(stats: DataFrame, total: str, parts: Sequence[str]) -> None:
    """Raises unless the parts add up to the total in every row."""
    bad = stats.where(F.col(total) != sum((F.col(p) for p in parts), F.lit(0))).limit(1).collect()
    if bad:
        raise ValueError(f"{total} isn't the sum of {', '.join(parts)}: {bad[0].asDict()}")


def short_ids(events: DataFrame, size: int = 8) -> DataFrame:
    """id, short: the first characters where they are one id's only, else the id."""
    same = Window.partitionBy(F.substring("id", 1, size))
    return events.select("id").distinct().withColumn("short", F.when(F.count("*").over(same) == 1, F.substring("id", 1, size)).otherwise(F.col("id")))


def author(actor: Column, source: Column) -> Column:
    return F.struct(F.coalesce(F.nullif(actor, F.lit("")), F.lit("unknown")).alias("actor"), source.alias("source"))
