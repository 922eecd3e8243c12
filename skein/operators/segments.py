"""What of session events may be searched: public texts of user and assistant messages, and why the rest isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import times

#: Kinds of events that hold messages, block types that are public, roles that aren't.
CLAUDE, CODEX = ("claude/user", "claude/assistant"), ("codex/user_message", "codex/agent_message", "codex/message")
PUBLIC, PRIVATE_ROLES = ("text", "input_text", "output_text"), ("system", "developer")
_UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})(?:\.jsonl)?$"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _string(v: Column, path: str) -> Column:
    """A string that isn't empty."""
    return F.nullif(F.when(_is(_at(v, path), "STRING"), F.try_variant_get(v, path, "string")), F.lit(""))


def extracted(rows: DataFrame) -> DataFrame:
    """file, line, id, kind, status (searchable, other or error), reason, platform, session, role, source, source_line, at, texts, a row for each accepted line.

    rows: classified lines (operators.log). A message needs an id, a time, the place it
    comes from, a session and the role of its kind; it is an error without them, and so is
    one whose content isn't a string or an array of typed blocks. Blocks of other types
    than the public ones, messages of private roles, and events that aren't messages are
    other. A codex session is named by the first head of its file, else by the file name.
    """
    p = F.col("__p")
    rows = rows.where("class in ('accepted', 'nonconforming')").withColumn("__p", F.try_parse_json("payload")).withColumn("__o", _at(p, "$.payload"))
    heads = rows.where("kind = 'codex/session_meta'").withColumn("s", _string(F.col("__o"), "$.id")).where("s is not null")
    heads = heads.groupBy("file").agg(F.min_by("s", "line").alias("__session"))
    rows = rows.join(heads, "file", "left")
    o, kind = F.col("__o"), F.col("kind")
    claude, codex = F.coalesce(kind.isin(*CLAUDE), F.lit(False)), F.coalesce(kind.isin(*CODEX), F.lit(False))
    said = F.coalesce(_at(o, "$.message"), _at(o, "$.content"))
    content = F.when(claude, _at(p, "$.message.content")).when(kind == "codex/message", _at(o, "$.content")).otherwise(said)
    role = F.when(claude, _string(p, "$.message.role")).when(kind == "codex/user_message", "user").when(kind == "codex/agent_message", "assistant").otherwise(_string(o, "$.role"))
    source = _string(p, "$.source.path")
    number = F.when(_at(p, "$.source.line").isNotNull() & F.schema_of_variant(_at(p, "$.source.line")).rlike("^(TINYINT|SMALLINT|INT|BIGINT)"), F.try_variant_get(p, "$.source.line", "long"))
    by_name = F.nullif(F.regexp_extract(F.regexp_replace(F.substring_index("source", "/", -1), r"\.lync$", ""), _UUID, 1), F.lit(""))
    session = F.coalesce(F.when(claude, _string(p, "$.source.sessionId")).otherwise(F.col("__session")), by_name)
    rows = rows.withColumns({"__content": content, "role": role, "source": source, "source_line": F.when(number >= 1, number)}).withColumn("session", session)
    blocks = F.try_variant_get("__content", "$", "array<variant>")
    rows = rows.withColumns({"__string": _is(F.col("__content"), "STRING"), "__array": _is(F.col("__content"), "ARRAY"), "__blocks": blocks})
    kind_of = lambda b: F.when(_is(_at(b, "$.type"), "STRING"), F.try_variant_get(b, "$.type", "string"))
    text_of = lambda b: F.when(_is(_at(b, "$.text"), "STRING"), F.try_variant_get(b, "$.text", "string"))
    parsed = F.transform("__blocks", lambda b: F.struct(kind_of(b).alias("type"), text_of(b).alias("text")))
    rows = rows.withColumn("__parsed", parsed)
    public = F.filter("__parsed", lambda b: b["type"].isin(*PUBLIC))
    texts = F.when(F.col("__string"), F.array(F.try_variant_get("__content", "$", "string"))).otherwise(F.transform(public, lambda b: b["text"]))
    texts = F.filter(texts, lambda t: t != "")
    structure = F.when(claude, ~(_is(_at(p, "$.message"), "OBJECT") & _is(_at(p, "$.source"), "OBJECT"))).otherwise(~_is(o, "OBJECT"))
    expected = F.substring_index("kind", "/", -1)
    error = (
        F.when(structure, "message payload structure is invalid")
        .when(claude & ~F.coalesce(F.col("role") == expected, F.lit(False)), "message role is missing or inconsistent with kind")
        .when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "message role is missing or invalid")
        .when(F.coalesce("id", F.lit("")) == "", "message event has invalid id")
        .when(~F.coalesce(times.is_rfc3339(F.col("at")), F.lit(False)), "message event has invalid at timestamp")
        .when(F.col("source").isNull() | F.col("source_line").isNull(), "message source coordinate is missing or invalid")
        .when(F.col("session").isNull(), "message session id is missing or invalid")
        .when(~F.col("__string") & ~F.col("__array"), "message content is missing or invalid")
        .when(F.exists("__parsed", lambda b: b["type"].isNull()), "message content block is invalid")
        .when(F.exists("__parsed", lambda b: b["type"].isin(*PUBLIC) & b["text"].isNull()), "public message text block is missing text")
    )
    private = F.when(~(claude | codex), "not a message").when((kind == "codex/message") & F.col("role").isin(*PRIVATE_ROLES), "system or developer message")
    rows = rows.withColumns({"__private": private, "__error": error, "texts": texts})
    reason = F.coalesce("__private", "__error", F.when(F.size("texts") == 0, "message without public text"))
    status = F.when(F.col("__private").isNull() & F.col("__error").isNotNull(), "error").when(reason.isNotNull(), "other").otherwise("searchable")
    platform = F.when(claude, "claude").when(codex, "codex")
    return rows.select("file", "line", "id", "kind", status.alias("status"), reason.alias("reason"), platform.alias("platform"), "session", "role", "source", "source_line", "at", F.when(status == "searchable", F.col("texts")).alias("texts"), "body_digest")


def segments(found: DataFrame) -> DataFrame:
    """file, source, line, event_id, segment, platform, session, role, kind, at, text of what may be searched, once for each place (source, line, event_id, segment)."""
    rows = found.where("status = 'searchable'").select("file", "source", F.col("source_line").alias("line"), F.col("id").alias("event_id"), F.posexplode("texts").alias("segment", "text"), "platform", "session", "role", "kind", "at")
    rows = rows.dropDuplicates(["source", "line", "event_id", "segment"])
    return rows.select("file", "source", "line", "event_id", "segment", "platform", "session", "role", "kind", "at", "text")
