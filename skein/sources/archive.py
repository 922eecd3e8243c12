"""Social archives: the data files of a post archive, bare post files, media, context fetched elsewhere."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POST = "struct<id:string,id_str:string,tweetId:string,full_text:string,fullText:string,text:string,created_at:string,createdAt:string,in_reply_to_status_id:string,in_reply_to_status_id_str:string,inReplyTo:string,in_reply_to_user_id:string,in_reply_to_user_id_str:string,entities:struct<urls:array<struct<url:string,expanded_url:string>>>>"
_LENIENT = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}
#: String literals are matched first and kept, so that only commas outside them go.
_TRAILING = r"""("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')|,(?=\s*[}\]])"""
ITEM = ("id", "text", "created_at", "parent_id", "reply_user_id", "account_id", "source", "ord", "urls")


def literal_body(value: Column) -> Column:
    """The JSON of a data file: without the assignment before it, the semicolon after it and trailing commas. Never evaluated."""
    body = F.regexp_replace(F.regexp_replace(value, r"^\s*[A-Za-z_$][A-Za-z0-9_.$]*\s*=\s*", ""), r";?\s*$", "")
    return F.regexp_replace(body, _TRAILING, "$1")


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def is_archive(spark: SparkSession, root: str) -> bool:
    """Whether data/manifest.js is there."""
    return _exists(spark, f"{root}/data/manifest.js")


def detect(spark: SparkSession, root: str) -> str | None:
    """The first kind of source that fits, in a fixed order."""
    if is_archive(spark, root):
        return "twitter"
    return "bluesky" if PurePosixPath(root).suffix == ".car" else None


def _first(record: Column, *names: str) -> Column:
    """The first of the fields that is neither absent nor empty."""
    return F.coalesce(*(F.nullif(record[n], F.lit("")) for n in names))


def normalised(rows: DataFrame, record: Column, source: Column, account: Column) -> DataFrame:
    """Items of post records; one without an id is dropped."""
    out = rows.select(
        _first(record, "id", "tweetId", "id_str").alias("id"),
        F.coalesce(_first(record, "text", "fullText", "full_text"), F.lit("")).alias("text"),
        _first(record, "created_at", "createdAt").alias("created_at"),
        _first(record, "in_reply_to_status_id", "inReplyTo", "in_reply_to_status_id_str").alias("parent_id"),
        _first(record, "in_reply_to_user_id", "in_reply_to_user_id_str").alias("reply_user_id"),
        account.alias("account_id"),
        source.alias("source"),
        "ord",
        record["entities"]["urls"].alias("urls"),
        record["full_text"].isNotNull().alias("has_full_text"),
    )
    return out.where(F.col("id").isNotNull())


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("value", literal_body(F.col("value")))


def account_id(spark: SparkSession, root: str) -> str | None:
    """The owner's id, or None; one small file, read on the driver."""
    shape = "array<struct<account:struct<accountId:string,username:string>>>"
    path = f"{root}/data/account.js"
    if not _exists(spark, path):
        return None
    row = _whole(spark, path).select(F.from_json("value", shape, _LENIENT).alias("a")).first()
    return row["a"][0]["account"]["accountId"] if row and row["a"] else None


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """Items of the posts and likes that the manifest lists, in its order."""
    shape = "struct<dataTypes:map<string,struct<files:array<struct<fileName:string>>>>>"
    manifest = _whole(spark, f"{root}/data/manifest.js").select(F.from_json("value", shape, _LENIENT).alias("m")).first()["m"]
    account = F.lit(account_id(spark, root)).cast("string")
    listed = [(kind, x["fileName"]) for kind, d in (manifest["dataTypes"] if manifest else {}).items() if kind in ("tweets", "tweet", "like") for x in d["files"] or []]
    out = None
    for i, (kind, name) in enumerate(listed):
        key = "like" if kind == "like" else "tweet"
        rows = _whole(spark, f"{root}/{name}").select(F.posexplode_outer(F.from_json("value", f"array<struct<{key}:{POST}>>", _LENIENT)).alias("at", "r"))
        rows = rows.where("r is not null").withColumn("ord", F.lit(i * 10**12) + F.col("at"))
        items = normalised(rows, F.col(f"r.{key}"), F.lit(f"twitter:{key}"), account)
        out = items if out is None else out.unionByName(items)
    return out if out is not None else spark.createDataFrame([], "id string, text string, created_at string, parent_id string, reply_user_id string, account_id string, source string, ord long, urls array<struct<url:string,expanded_url:string>>, has_full_text boolean")


def read_bare_posts(spark: SparkSession, path: str, account: str | None = None) -> DataFrame:
    """A file with an array of post records, all of one owner."""
    rows = _whole(spark, path).select(F.posexplode(F.from_json("value", f"array<{POST}>", _LENIENT)).alias("at", "r")).withColumn("ord", F.col("at").cast("long"))
    return normalised(rows, F.col("r"), F.lit("twitter:tweet"), F.lit(account).cast("string"))


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """id, media: non-empty files named <post id>-..., grouped by post."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-*").option("recursiveFileLookup", "true").load(f"{root}/data").select("path", "length")
    name = F.substring_index("path", "/", -1)
    kind = F.lower(F.substring_index(name, ".", -1))
    known = files.where("length > 0").select(
        F.regexp_extract(name, "^([0-9]+)-", 1).alias("id"),
        F.struct(
            F.concat_ws("_", F.regexp_extract(name, "^([0-9]+)-", 1), F.regexp_replace(F.regexp_replace(name, "^[0-9]+-", ""), r"\.[^.]*$", "")).alias("id"),
            F.when(kind.isin("mp4", "mov"), "video").when(kind.isin("jpg", "jpeg", "png", "gif"), "photo").otherwise("unknown").alias("content_type"),
            F.col("path").alias("abs_path"),
        ).alias("m"),
    )
    return known.where("id != ''").groupBy("id").agg(F.array_sort(F.collect_list("m")).alias("media"))


def with_media(items: DataFrame, media: DataFrame) -> DataFrame:
    return items.join(media, "id", "left")


def enriched(items: DataFrame, fetched: DataFrame) -> DataFrame:
    """Items and those fetched for context that aren't among them, once each; what to fetch is the caller's, see missing()."""
    new = fetched.join(items.select("id"), "id", "left_anti").dropDuplicates(["id"]).withColumn("source", F.lit("bluesky:fetched"))
    return items.unionByName(new, allowMissingColumns=True)


def missing(items: DataFrame) -> DataFrame:
    have = items.select(F.col("id").alias("parent_id"))
    return items.where("parent_id is not null").join(have, "parent_id", "left_anti").select(F.col("parent_id").alias("id")).distinct()


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one to a line or as a JSON array."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")), "array<string>"), F.split("value", r"\r?\n"))
    return whole.select(F.explode(listed).alias("id")).select(F.trim("id").alias("id")).where("id != ''")


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of a JSON lines file; unreadable lines are passed over, or raise when strict."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path)


def first_of_files(rows: DataFrame, key: str) -> DataFrame:
    """The first row of each key by file name."""
    w = Window.partitionBy(key).orderBy("file")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
