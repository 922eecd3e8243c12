"""Files from tables: JSON lines, chat formats, Markdown posts, character data sets, event files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import ids, text


def chat_lines(messages: DataFrame, group: list[str], system: str | None = None) -> DataFrame:
    """value: {"messages": [...]}, one row for each group; messages: role, content, island."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("island", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    head = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))) if system else None
    rows = messages.groupBy(*group).agg(parts.alias("messages"))
    return rows.select(*group, F.to_json(F.struct((F.concat(head, "messages") if system else F.col("messages")).alias("messages"))).alias("value"))


def sharegpt_lines(messages: DataFrame, group: list[str]) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("island", "role", "content"))), lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), m["content"].alias("value")))
    return messages.groupBy(*group).agg(parts.alias("conversations")).select(*group, F.to_json(F.struct("conversations")).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)


def write_items(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def event_lines(events: DataFrame, digest: bool = False, carried: Sequence[str] = ()) -> DataFrame:
    """id, the carried columns and value: an event's compact line, keys in the canonical order; events: id, kind, at, actor, parents, payload (JSON text), critical."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    parents = F.concat(F.lit("["), F.array_join(F.transform("parents", lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ","), F.lit("]"))
    line = F.concat(F.lit('{"v":1,"id":'), quoted("id"), F.lit(',"kind":'), quoted("kind"), F.lit(',"at":'), quoted("at"), F.lit(',"author":{"actor":'), quoted("actor"), F.lit('},"parents":'), parents, F.lit(',"payload":'), F.col("payload"), F.when(F.col("critical"), ',"critical":true').otherwise(""), F.lit("}"))
    return events.select("id", *carried, (ids.with_digest(line) if digest else line).alias("value"))


def markdown_posts(chained: DataFrame) -> DataFrame:
    """path, body, ord: threads of more than one item, and single posts of the owner that are in none. Of equal paths the last wins; see collisions().

    chained: chain_id, kind, pos, id, text, at (timestamp), source, handle, ord.
    """
    size = F.count("*").over(Window.partitionBy("chain_id"))
    rows = chained.where("kind = 'thread'").withColumn("n", size)
    in_thread = rows.where("n > 1").select("id").distinct()
    single = rows.where((F.col("n") == 1) & ~text.is_retweet(F.col("text"))).join(in_thread, "id", "left_anti")
    both = rows.where("n > 1").withColumn("folder", F.lit("threads")).unionByName(single.withColumn("folder", F.lit("tweets")), allowMissingColumns=True)
    link = text.permalink(F.col("source"), F.col("id"), F.col("handle"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text", "at", link.alias("link"), "ord")))
    docs = both.groupBy("folder", "chain_id").agg(parts.alias("p"))
    first = F.col("p")[0]
    day = F.date_format(first["at"], "yyyyMMdd")
    body = F.concat(F.lit("---\ndate: "), F.date_format(first["at"], "yyyy-MM-dd"), F.lit("\n---\n\n"), F.array_join(F.transform("p", lambda x: text.isolate_links(x["text"])), "\n\n---\n\n"), F.coalesce(F.concat(F.lit("\n\n["), F.lit("source]("), first["link"], F.lit(")")), F.lit("")), F.lit("\n"))
    return docs.select(F.concat_ws("/", "folder", day, F.concat(text.slug(first["text"]), F.lit(".md"))).alias("path"), body.alias("body"), first["ord"].alias("ord"))


def last_of_path(documents: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("ord"))
    return documents.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def collisions(documents: DataFrame) -> DataFrame:
    return documents.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def write_documents(documents: DataFrame, root: str) -> None:
    """Each body at its path under root, written by the tasks; root has to be one that all executors share."""

    def put(rows: Iterator) -> None:
        import pathlib

        for r in rows:
            p = pathlib.Path(root) / r["path"]
            p.parent.mkdir(parents=True, exist_ok=True)
            t = p.with_name(p.name + ".part")
            t.write_text(r["body"])
            t.replace(p)

    last_of_path(documents).select("path", "body").foreachPartition(put)


def archive_stats(items: DataFrame, chained: DataFrame) -> DataFrame:
    """One row: items, tweets, likes, threads, conversations, first and last time."""
    kinds = chained.select("chain_id", "kind").distinct().agg(F.count(F.when(F.col("kind") == "thread", 1)).alias("threads"), F.count(F.when(F.col("kind") == "conversation", 1)).alias("conversations"))
    per = items.agg(F.count("*").alias("items"), F.count(F.when(F.col("source") == "twitter:tweet", 1)).alias("tweets"), F.count(F.when(F.col("source") == "twitter:like", 1)).alias("likes"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    return per.crossJoin(kinds)  # one row each


def character_files(segments: DataFrame, display: str = "display") -> DataFrame:
    """character_dir, value: a line for each segment of a character, its prompt first; segments: key, display, user_text, assistant_text."""
    s = segments.select(text.character_id(F.col("key")).alias("character_dir"), F.array(F.struct(F.lit("system").alias("role"), text.system_prompt(F.col(display), F.col("key"), F.col("key")).alias("content")), F.struct(F.lit("user").alias("role"), F.col("user_text").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("assistant_text").alias("content"))).alias("messages"))
    return s.select("character_dir", F.to_json(F.struct("messages")).alias("value"))


def write_character_files(lines: DataFrame, root: str) -> None:
    lines.write.mode("overwrite").partitionBy("character_dir").text(root)
