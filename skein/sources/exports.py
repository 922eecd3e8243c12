"""Chat exports, thread exports, embed caches, page directories and event files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import ids, text, times
from skein.sources.lines import numbered_lines

THREAD = "struct<id:string,title:string,url:string,posts:array<struct<post_id:string,author:string,character_display_name:string,character_handle:string,timestamp:string,content:string>>>"


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Posts of thread.json files: thread_id, ord, id, handle, display, author, created_at, text. A file without id and posts raises."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", THREAD).alias("t"))
    rows = rows.withColumn("t", F.when(F.col("t.id").isNotNull() & F.col("t.posts").isNotNull(), F.col("t")).otherwise(F.raise_error(F.lit("a thread needs id and posts")).cast(THREAD)))
    p = rows.select(F.col("t.id").alias("thread_id"), F.posexplode("t.posts").alias("ord", "p"))
    own = F.coalesce(F.nullif("p.post_id", F.lit("")), F.concat(F.lit("idx-"), F.col("ord").cast("string")))
    return p.select(
        "thread_id",
        F.col("ord").cast("long").alias("ord"),
        F.concat_ws(":", "thread_id", own).alias("id"),
        F.col("p.character_handle").alias("handle"),
        F.col("p.character_display_name").alias("display"),
        F.col("p.author").alias("author"),
        times.parse(F.col("p.timestamp")).alias("created_at"),
        text.html_to_markdown(F.coalesce("p.content", F.lit(""))).alias("text"),
    )


def turn_text(v: Column) -> Column:
    """Text of a message: itself, its text, its content, its blocks' texts, or a stand-in that names the blocks; never empty."""
    get = lambda p: F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))
    kind = F.schema_of_variant(v)
    blocks = F.try_variant_get(v, "$.content", "array<variant>")
    texts = F.array_join(F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    named = F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("["), F.concat_ws(":", F.try_variant_get(b, "$.type", "string"), F.try_variant_get(b, "$.name", "string")), F.lit("]"))), "\n")
    plain = F.when(kind == "STRING", get("$"))
    content = F.when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING", get("$.content"))
    return F.coalesce(plain, get("$.text"), content, F.nullif(texts, F.lit("")), F.nullif(named, F.lit("")), F.lit("[empty message]"))


def _array_of(spark: SparkSession, path: str) -> DataFrame:
    """One row (ord, v) for each element of a file's top-level array; anything else raises."""
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("j"))
    good = F.schema_of_variant("j").startswith("ARRAY")
    items = F.when(F.coalesce(good, F.lit(False)), F.try_variant_get("j", "$", "array<variant>")).otherwise(F.raise_error(F.lit("an export is an array")).cast("array<variant>"))
    return rows.select(F.posexplode(items).alias("ord", "v"))


def read_claude_export(spark: SparkSession, path: str) -> DataFrame:
    """Turns: conv, title, ord, id, parent_id, role, model, text, created_at. Linear unless some message names its parent; malformed rows have skip set."""
    c = _array_of(spark, path).withColumn("m", F.try_variant_get("v", "$.chat_messages", "array<variant>"))
    get = lambda p, v="v": F.try_variant_get(v, p, "string")
    bad = c.where("m is null").select(F.col("ord").alias("conv_ord"), F.lit("no chat_messages").alias("skip"))
    t = c.where("m is not null").select(F.col("ord").alias("conv_ord"), get("$.uuid").alias("conv"), get("$.name").alias("title"), F.posexplode("m").alias("ord", "msg"))
    is_object = F.schema_of_variant("msg").startswith("OBJECT")
    t = t.withColumn("skip", F.when(~is_object, "message isn't an object"))
    t = t.select("conv_ord", "conv", "title", "ord", "skip", get("$.uuid", "msg").alias("id"), get("$.parent_message_uuid", "msg").alias("named"), F.when(get("$.sender", "msg") == "human", "user").otherwise(get("$.sender", "msg")).alias("role"), get("$.model", "msg").alias("model"), turn_text(F.col("msg")).alias("text"), get("$.created_at", "msg").alias("created_at"))
    per = Window.partitionBy("conv_ord")
    tree = F.bool_or(F.col("named").isNotNull()).over(per)
    before = F.last(F.when(F.col("skip").isNull(), F.col("id")), ignorenulls=True).over(per.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("parent_id", F.when(tree, F.col("named")).otherwise(before)).drop("named").unionByName(bad, allowMissingColumns=True)


def read_chatgpt_export(spark: SparkSession, path: str) -> DataFrame:
    """Nodes: conv, title, id, parent_id, role, model, text, has_message, skip. A node without message is a placeholder in the tree."""
    c = _array_of(spark, path).withColumn("nodes", F.try_variant_get("v", "$.mapping", "map<string,variant>"))
    get = lambda p, v="v": F.try_variant_get(v, p, "string")
    bad = c.where("nodes is null").select(F.col("ord").alias("conv_ord"), F.lit("no mapping").alias("skip"))
    n = c.where("nodes is not null").select(F.col("ord").alias("conv_ord"), F.coalesce(get("$.id"), get("$.conversation_id")).alias("conv"), get("$.title").alias("title"), F.explode("nodes").alias("id", "n"))
    parts = F.try_variant_get("n", "$.message.content.parts", "array<variant>")
    texts = F.array_join(F.filter(F.transform(parts, lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.try_variant_get(p, "$.text", "string"), F.concat(F.lit("["), F.try_variant_get(p, "$.content_type", "string"), F.lit("]")))), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    body = F.coalesce(F.nullif(texts, F.lit("")), F.nullif(get("$.message.content.text", "n"), F.lit("")), F.concat(F.lit("["), get("$.message.content.content_type", "n"), F.lit("]")), F.lit("[empty message]"))
    message = F.coalesce(F.schema_of_variant(F.try_variant_get("n", "$.message", "variant")).startswith("OBJECT"), F.lit(False))
    skip = F.when(~F.schema_of_variant("n").startswith("OBJECT"), "node isn't an object")
    out = n.select("conv_ord", "conv", "title", "id", get("$.parent", "n").alias("parent_id"), get("$.message.author.role", "n").alias("role"), get("$.message.metadata.model_slug", "n").alias("model"), F.when(message, body).alias("text"), message.alias("has_message"), skip.alias("skip"))
    return out.unionByName(bad, allowMissingColumns=True)


def read_embed_cache(spark: SparkSession, path: str, fallback: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Posts of an embed cache: file, id, actor, text, at, rung, skip. An id comes from the address and the file name, which have to agree."""
    shape = "struct<url:string,author_name:string,author_url:string,html:string,cached_at:string>"
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", shape).alias("r"))
    by_url, by_name = F.regexp_extract("r.url", "/status(?:es)?/([0-9]+)", 1), F.regexp_extract("file", "^([0-9]+)", 1)
    known = F.coalesce(F.nullif(by_url, F.lit("")), F.nullif(by_name, F.lit("")))
    skip = F.when(F.col("r.url").isNull() & F.col("r.html").isNull(), "unreadable").when(known.isNull(), "no id").when((by_url != "") & (by_name != "") & (by_url != by_name), "ids disagree")
    when = times.ladder(known, F.col("r.html"), F.col("r.cached_at"), F.to_timestamp(F.lit(fallback)))
    none = F.lit("")
    actor = F.coalesce(F.nullif(F.regexp_extract("r.author_url", r"\.com/([A-Za-z0-9_]+)", 1), none), F.nullif(F.regexp_extract("r.html", r"\(@([A-Za-z0-9_]+)\)", 1), none), F.nullif("r.author_name", none), F.lit("unknown"))
    body = text.html_to_markdown(F.regexp_extract("r.html", "(?s)<p[^>]*>(.*?)</p>", 1))
    return rows.select("file", known.alias("id"), actor.alias("actor"), body.alias("text"), when.alias("w"), skip.alias("skip")).select("file", "id", "actor", "text", "w.at", "w.rung", "skip")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (page, desc, document, skip), number, bytes, chosen: the first page or desc file of a number, by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    # Spark's readers pass over empty files, so names and sizes come from the listing
    listed = [(x.getPath().getName(), x.getLen()) for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if x.isFile()]
    read = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), F.col("content").cast("string").alias("text"))
    f = spark.createDataFrame(listed, "file string, bytes long").join(read, "file", "left").withColumn("text", F.coalesce("text", F.lit("")))
    number = F.coalesce(F.nullif(F.regexp_extract("file", r"^page-([0-9]+)(\.desc)?\.txt$", 1), F.lit("")))
    kind = F.when(F.col("file").rlike(r"^page-[0-9]+\.txt$"), "page").when(F.col("file").rlike(r"^page-[0-9]+\.desc\.txt$"), "desc").when(F.col("file").rlike(r"\.md$"), "document").otherwise("skip")
    f = f.select("file", kind.alias("kind"), number.cast("long").alias("number"), "bytes", "text")
    return f.withColumn("chosen", F.col("number").isNull() | (F.row_number().over(Window.partitionBy("kind", "number").orderBy("file")) == 1))


def page_report(files: DataFrame) -> DataFrame:
    """problem, number: pages without a desc, descs without a page, empty pages, duplicates."""
    kept = files.where("chosen")
    pages, descs = (kept.where(F.col("kind") == k).select("number") for k in ("page", "desc"))
    parts = [(pages.join(descs, "number", "left_anti"), "missing desc"), (descs.join(pages, "number", "left_anti"), "orphan desc"), (kept.where("kind = 'page' and bytes = 0").select("number"), "empty"), (files.where("not chosen").select("number"), "duplicate")]
    out = None
    for df, name in parts:
        df = df.select(F.lit(name).alias("problem"), "number")
        out = df if out is None else out.unionByName(df)
    return out


def page_gaps(pages: DataFrame, number: str = "number") -> DataFrame:
    """first, last: the runs of numbers between the least and the greatest one that no page has; a run is one row, however long."""
    p = pages.where(F.col(number).isNotNull()).select(F.col(number).cast("long").alias("n")).distinct().withColumn("part", F.floor(F.col("n") / 65536))
    # neighbours within ranges of numbers, then between ranges
    inside = p.withColumn("next", F.lead("n").over(Window.partitionBy("part").orderBy("n"))).select("n", "next")
    ends = p.groupBy("part").agg(F.min("n").alias("a"), F.max("n").alias("n"))
    between = ends.select("n", F.lead("a").over(Window.orderBy("part")).alias("next"))
    return inside.unionByName(between).where("next > n + 1").select((F.col("n") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank ones counted), text: the lines that aren't blank, of event files and session files of any size, for operators.log and operators.sessions."""
    return numbered_lines(spark, path).where("text != ''")


def read_large_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place, text: lines of files of any size. Files are split between tasks, so a line has no number; place (block, row) rises with the lines of a file."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33)).alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("place"), F.regexp_replace("value", "\r$", "").alias("text")).where("text != ''")


def scan_tree(spark: SparkSession, root: str, suffix: str = ".jsonl") -> DataFrame:
    """path (below root), bytes, taken: files of a tree of any depth; what doesn't end in suffix is ignored, and says so. Spark lists no empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return found.select(_below(root).alias("path"), F.col("length").alias("bytes"), F.endswith("path", F.lit(suffix)).alias("taken"))


def file_digests(spark: SparkSession, root: str, suffix: str = ".jsonl") -> DataFrame:
    """path (below root), bytes, sha256 of the files that end in suffix; a file is a row, of 2 GB at most. Spark lists no empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    return found.select(_below(root).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _below(root: str) -> Column:
    """A file's path without that of the root, however either is written."""
    folder = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    return F.regexp_replace("path", f"^.*?{re.escape(folder)}/+", "")


def below(column: str, root: str) -> Column:
    """A file's path below a folder; paths in rows of text files are written like addresses."""
    folder = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    return F.regexp_replace(F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), f"^.*?{re.escape(folder)}/+", "")


def is_thread_url(url: Column, host: str) -> Column:
    """Whether a URL, or a bare path, names a thread, a section or a board of a host."""
    name, route = re.escape(host), "/(posts|board_sections|boards)/"
    whole = url.rlike(f"^(?i)[a-z][a-z0-9+.-]*://([^/?#]*[.@])?{name}(:[0-9]+)?/")
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), whole & path.rlike(route)).otherwise(url.rlike(name + route)), F.lit(False))


def embed_media(uri: Column, record: Column, levels: int = 4) -> Column:
    """id, content_type, cid, mime, size, alt of the images or the video that a post's record (a variant) embeds; media beside a quoted record are found up to levels deep.

    An image without a blob is a null entry, a video without one is no entry.
    """
    text = lambda v, p: F.try_variant_get(v, p, "string")

    def blob(v: Column, at: str, suffix: Column, kind: str, alt: Column) -> Column:
        name = F.concat(uri, F.lit("#"), suffix)
        cid = F.coalesce(text(v, f"{at}.cid"), text(v, f'{at}.ref["$link"]'), name)
        made = F.struct(name.alias("id"), F.lit(kind).alias("content_type"), cid.alias("cid"), text(v, f"{at}.mimeType").alias("mime"), F.try_variant_get(v, f"{at}.size", "long").alias("size"), alt.alias("alt"))
        return F.when(F.try_variant_get(v, at, "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get(v, at, "variant")), made)

    def of(at: str, left: int) -> Column:
        kind = text(record, f'{at}["$type"]')
        images = F.try_variant_get(record, f"{at}.images", "array<variant>")
        pictures = F.transform(images, lambda v, i: blob(v, "$.image", F.concat(F.lit("image-"), i.cast("string")), "photo", text(v, "$.alt")))
        video = F.array_compact(F.array(blob(record, f"{at}.video", F.lit("video"), "video", text(record, f"{at}.alt"))))
        found = F.when(kind == "app.bsky.embed.images", pictures).when(kind == "app.bsky.embed.video", video)
        return found.when(kind == "app.bsky.embed.recordWithMedia", of(f"{at}.media", left - 1)) if left else found

    return F.coalesce(of("$.embed", levels), F.array().cast("array<struct<id:string,content_type:string,cid:string,mime:string,size:bigint,alt:string>>"))


def detect_machine_kind(v: Column) -> Column:
    """loom or optimizer, by the keys of a story machine's file; null for anything else."""
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return F.when(has("loom") & has("turns"), "loom").when(has("runId") & has("trajectories"), "optimizer")


def read_story_loom(spark: SparkSession, path: str) -> DataFrame:
    """Turns as events: id, kind, at, actor, parents. Compositions take their references for parents, others their parent, then unseen references."""
    shape = "struct<loom:struct<id:string>,turns:array<struct<id:string,parentId:string,createdAt:long,payload:struct<text:string>,meta:struct<role:string,author:string,references:array<string>>>>>"
    t = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("f")).select(F.col("f.loom.id").alias("loom"), F.posexplode("f.turns").alias("ord", "t"))
    name = lambda c: ids.event_id(F.lit("story-machine"), F.col("loom"), c)
    refs = F.coalesce("t.meta.references", F.array().cast("array<string>"))
    up = F.when(F.col("t.parentId").isNotNull(), F.array("t.parentId")).otherwise(F.array().cast("array<string>"))
    parents = F.when((F.col("t.meta.role") == "composition") & (F.size(refs) > 0), refs).otherwise(F.array_distinct(F.concat(up, refs)))
    at = F.date_format(F.date_trunc("second", F.timestamp_millis("t.createdAt")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = t.select("loom", "ord", name(F.col("t.id")).alias("id"), F.concat(F.lit("story-machine/"), F.coalesce("t.meta.role", F.lit("turn"))).alias("kind"), at.alias("at"), F.coalesce("t.meta.author", F.lit("unknown")).alias("actor"), F.col("t.payload.text").alias("text"), F.posexplode_outer(parents).alias("i", "p"))
    keys = ("loom", "ord", "id", "kind", "at", "actor", "text")
    return out.withColumn("p", name(F.col("p"))).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("i", "p")))), lambda x: x["p"]).alias("parents"))
