"""Agent-session logs: repeated records, sequence parents and call pairing.

rows: file, line, and the fields named by each operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import ids, times

#: Types without an identity that only point at something; keys of a session's head that name other sessions; pointers and annotations.
POINTER_TYPES, LINEAGE = ("ai-title", "last-prompt", "mode"), ("forked_from_id", "parent_thread_id")
POINTER, ANNOTATION = "lore/pointer", "lore/annotation"


def repeats(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Adds role: canonical for a key's first record in (file, line) order; then pointer where the bytes are equal, else annotation."""
    w = Window.partitionBy(key).orderBy("file", "line")
    digest = F.sha2(content, 256)
    first = F.first(digest).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("role", F.when(F.row_number().over(w) == 1, "canonical").when(first == digest, "pointer").otherwise("annotation"))


def sequence_parents(rows: DataFrame, event: str = "id") -> DataFrame:
    """Adds previous: the event before it in its file."""
    return rows.withColumn("previous", F.lag(event).over(Window.partitionBy("file").orderBy("line")))


def call_parents(rows: DataFrame, is_call: Column, is_output: Column, event: str = "id") -> DataFrame:
    """Adds call: for an output, the latest earlier call of its file with the same call_id."""
    before = Window.partitionBy("file", "call_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(is_call, F.col(event)), ignorenulls=True).over(before)
    return rows.withColumn("call", F.when(is_output, latest))


def session_ids(rows: DataFrame, declared: Column) -> DataFrame:
    """Adds session: the first one that the file declares, else the UUID in its name."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.nullif(F.regexp_extract("file", "([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1), F.lit(""))
    return rows.withColumn("session", F.coalesce(F.first(declared, ignorenulls=True).over(w), named))


def _records(lines: DataFrame) -> DataFrame:
    """Adds j (the line as a variant) and skip: blank, invalid or non-object."""
    j = F.try_parse_json("text")
    kind = F.schema_of_variant("j")
    skip = F.when(F.trim("text") == "", "blank").when(F.col("j").isNull(), "invalid").when(~kind.startswith("OBJECT"), "non-object")
    return lines.withColumn("j", j).withColumn("skip", skip)


def _got(path: str, of: str = "j") -> Column:
    """A string field, null where it is empty or of another type."""
    kind = F.schema_of_variant(F.try_variant_get(of, path, "variant"))
    return F.nullif(F.when(kind == "STRING", F.try_variant_get(of, path, "string")), F.lit(""))


def claude_events(lines: DataFrame, fallback: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """file, line, skip, id, kind, role, at, parents, message, session: an event for each record of session files (file, line, text).

    A record with a uuid is canonical where that comes first in the whole tree (by file
    and line) and has its parent's id; a repeated one is a pointer to it if its bytes are
    equal, else an annotation. Records without a uuid are pointers or annotations by their type.
    """
    r = _records(lines).withColumn("uuid", F.when(F.col("skip").isNull(), _got("$.uuid"))).withColumn("type", F.coalesce(_got("$.type"), F.lit("unknown")))
    known = repeats(r.where("uuid is not null"), "uuid", F.col("text"))
    bare = F.when(F.col("skip").isNull(), F.when(F.col("type").isin(*POINTER_TYPES), "pointer").otherwise("annotation"))
    rows = known.unionByName(r.where("uuid is null").withColumn("role", bare))
    own, first = ids.event_id(F.lit("claude"), F.lit("line"), F.col("file"), F.col("line")), ids.event_id(F.lit("claude"), F.lit("record"), F.col("uuid"))
    up = _got("$.parentUuid")
    parents = F.when(F.col("role") == "canonical", F.when(up.isNotNull(), F.array(ids.event_id(F.lit("claude"), F.lit("record"), up)))).when(F.col("uuid").isNotNull(), F.array(first))
    kind = F.when(F.col("role") == "canonical", F.concat(F.lit("claude/"), "type")).when(F.col("role") == "pointer", POINTER).when(F.col("role") == "annotation", ANNOTATION)
    at = times.normalised(_got("$.timestamp"), F.lit(fallback))["at"]
    message = F.to_json(F.try_variant_get("j", "$.message", "variant"))
    shown = F.col("skip").isNull()
    return rows.select("file", "line", "skip", F.when(shown, F.when(F.col("role") == "canonical", first).otherwise(own)).alias("id"), kind.alias("kind"), "role", F.when(shown, at).alias("at"), F.coalesce(parents, F.array().cast("array<string>")).alias("parents"), message.alias("message"), _got("$.sessionId").alias("session"))


def codex_events(lines: DataFrame, fallback: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """file, line, sub, skip, id, kind, at, parents, body (JSON; null for the extra ones): an event for each record, and one more for each session that a session's head names.

    A record's kind goes by its payload's type; one without a payload is its own. Its
    parents are the event before it in the file, the extra ones among them, and for a
    call's output also the latest earlier call of that call_id.
    """
    r = _records(lines)
    body = F.when(F.coalesce(F.schema_of_variant(F.try_variant_get("j", "$.payload", "variant")).startswith("OBJECT"), F.lit(False)), F.try_variant_get("j", "$.payload", "variant")).otherwise(F.col("j"))
    r = r.withColumn("body", body).withColumn("outer", _got("$.type"))
    kind = F.concat(F.lit("codex/"), F.coalesce(_got("$.type", "body"), F.col("outer"), F.lit("unknown")))
    at = times.normalised(_got("$.timestamp"), F.lit(fallback))["at"]
    head = F.col("outer") == "session_meta"
    named = F.filter(F.array(*(F.when(head & _got(f"$.{k}", "body").isNotNull(), F.lit(k)) for k in LINEAGE)), lambda k: k.isNotNull())
    r = r.select("file", "line", "skip", kind.alias("kind"), at.alias("at"), _got("$.call_id", "body").alias("call_id"), F.to_json("body").alias("body"), F.coalesce(named, F.array().cast("array<string>")).alias("named"))
    rows = r.where("skip is null").select("file", "line", "kind", "at", "call_id", "body", F.posexplode(F.concat(F.array(F.lit("")), "named")).alias("sub", "key"))
    record = F.col("key") == ""
    rows = rows.withColumn("id", F.when(record, ids.event_id(F.lit("codex"), F.lit("record"), F.col("file"), F.col("line"))).otherwise(ids.event_id(F.lit("codex"), F.lit("lineage"), F.col("file"), F.col("line"), F.col("key"))))
    before = F.lag("id").over(Window.partitionBy("file").orderBy("line", "sub"))
    head_id = ids.event_id(F.lit("codex"), F.lit("record"), F.col("file"), F.col("line"))
    rows = rows.withColumn("previous", F.when(record, before).otherwise(head_id))
    rows = call_parents(rows, F.col("kind") == "codex/function_call", (F.col("kind") == "codex/function_call_output") & F.col("call_id").isNotNull())
    parents = F.array_distinct(F.filter(F.array("previous", "call"), lambda x: x.isNotNull()))
    out = rows.select("file", "line", "sub", F.lit(None).cast("string").alias("skip"), "id", F.when(record, F.col("kind")).otherwise(POINTER).alias("kind"), "at", parents.alias("parents"), F.when(record, F.col("body")).alias("body"))
    return out.unionByName(r.where("skip is not null").select("file", "line", F.lit(0).alias("sub"), "skip"), allowMissingColumns=True)


def locator(path: Column) -> Column:
    """A path's logical form: slashes, without empty and . parts; null where it is absolute, empty or leads out by .. parts."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    out = F.array_join(parts, "/")
    return F.when((out != "") & ~F.array_contains(parts, "..") & ~path.rlike(r"^([/\\]|[A-Za-z]:)"), out)


def collisions(files: DataFrame, path: str = "file") -> DataFrame:
    """locator, files: logical names that several files share (null: those that have none), to be refused before anything is written."""
    named = files.select(F.col(path).alias("f")).distinct().select("f", locator(F.col("f")).alias("locator"))
    return named.groupBy("locator").agg(F.array_sort(F.collect_set("f")).alias("files")).where("locator is null or size(files) > 1")


def file_report(events: DataFrame) -> DataFrame:
    """file, emitted, skipped, blank: what became of each file's lines."""
    n = lambda c: F.count(F.when(c, 1)).alias
    return events.groupBy("file").agg(n(F.col("skip").isNull())("emitted"), n(F.col("skip").isin("invalid", "non-object"))("skipped"), n(F.col("skip") == "blank")("blank"))


def public_rows(events: DataFrame) -> DataFrame:
    """file, line, id, session, role, part, text: what users and assistants said in canonical message records (kind, message, session), a row for each text that isn't blank.

    The message's role must be that of the kind. Content is a string or blocks, of which text ones are public.
    """
    said = F.substring_index("kind", "/", -1)
    m = events.where(F.col("kind").isin("claude/user", "claude/assistant")).withColumn("m", F.try_parse_json("message")).withColumn("said", said)
    m = m.where(_got("$.role", "m") == F.col("said"))
    plain = F.when(_got("$.content", "m").isNotNull(), F.array(F.struct(F.lit("text").alias("type"), _got("$.content", "m").alias("text"))))
    blocks = F.transform(F.try_variant_get("m", "$.content", "array<variant>"), lambda b: F.struct(F.try_variant_get(b, "$.type", "string").alias("type"), F.try_variant_get(b, "$.text", "string").alias("text")))
    rows = m.select("file", "line", "id", "session", F.col("said").alias("role"), F.posexplode(F.coalesce(plain, blocks)).alias("part", "b"))
    return rows.where((F.col("b.type") == "text") & (F.trim(F.coalesce("b.text", F.lit(""))) != "")).select("file", "line", "id", "session", "role", "part", F.col("b.text").alias("text"))
