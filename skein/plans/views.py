"""The driver's tables seen as items, posts, decisions and an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.sinks.files import event_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as items that reply to the turn before them."""
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    none = F.lit(None).cast("string")
    return c.select(
        name(F.col("turn")).alias("id"),
        "text",
        none.alias("created_at"),
        F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"),
        none.alias("reply_user_id"),
        none.alias("account_id"),
        F.when(F.col("role") == "assistant", "bluesky:post").otherwise("external").alias("source"),
        F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        "conv_id",
        "turn",
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k, the number in their props."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as decisions about one of ten items of theirs."""
    e = event_rows(spark, sf_dir)
    status = F.when(F.col("event_type") == "purchase", "export").when(F.col("event_type") == "error", "skip").when(F.col("event_type") == "click", "unread")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("k") % 10).cast("string")).alias("id"),
        status.alias("status"),
        F.array("event_type").alias("tags"),
        F.when(F.col("value") > 50, F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("notes"),
        F.when(F.col("k") % 7 != 0, F.col("ts") - F.make_interval(hours=F.col("k") % 48)).alias("ts"),
        F.when(F.col("k") % 2 == 0, F.col("user_id").cast("string")).alias("by"),
        F.col("event_id").alias("ord"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as artifacts that continue their user's view before; some lack a text, errors suppress or mark some."""
    e = event_rows(spark, sf_dir)
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    views = e.where("event_type = 'view'").withColumn("parent", F.lag("event_id").over(by_time))
    views = views.select("event_id", "user_id", "parent", F.when(F.col("k") >= 5, F.concat(F.lit("view "), F.col("event_id").cast("string"))).alias("text"))
    # a user's first view names one that isn't there in one of ten users
    views = views.withColumn("parent", F.when(F.col("parent").isNull() & (F.col("user_id") % 10 == 0), -F.col("event_id") - 1).otherwise(F.col("parent")))
    marks = latest_views(spark, sf_dir, shown=False).where("event_type = 'error' and target is not null").groupBy("target").agg(F.bool_or(F.col("event_id") % 20 == 0).alias("suppressed"), F.bool_or(F.col("event_id") % 20 == 1).alias("marked"))
    out = views.join(marks.withColumnRenamed("target", "event_id"), "event_id", "left")
    no = F.lit(False)
    return out.select(F.col("event_id").alias("id"), "parent", "text", F.coalesce("suppressed", no).alias("suppressed"), F.coalesce("marked", no).alias("marked"), F.col("user_id").cast("string").alias("actor"))


def latest_views(spark: SparkSession, sf_dir: str, shown: bool = True) -> DataFrame:
    """Every event with target, its user's latest earlier view, and shown, the last three, if asked for."""
    e = event_rows(spark, sf_dir)
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    number = F.count(view).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("target", F.last(view, ignorenulls=True).over(before)).withColumn("views", number)
    if not shown:
        return e
    recent = e.where("event_type = 'view'").select("user_id", F.col("views").alias("at"), F.col("event_id").alias("view"))
    asked = e.where("event_type = 'purchase'").select("event_id", "user_id", F.explode(F.expr("sequence(greatest(views - 3, 0), views)")).alias("at"), "views").where("at < views")
    last = asked.join(recent, ["user_id", "at"]).groupBy("event_id").agg(F.array_sort(F.collect_list("view")).alias("shown"))
    return e.join(last, "event_id", "left")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = latest_views(spark, sf_dir, shown=False).where("event_type = 'click' and target is not null")
    return c.select("target", F.col("event_id").alias("annotation"), "value")


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = latest_views(spark, sf_dir).where("event_type = 'purchase' and target is not null")
    return p.select(F.col("event_id").alias("id"), F.array("target").alias("chosen"), "shown")


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artifacts with their scores, selections, tombstones and no-train marks as lines of a log."""
    name = lambda c: F.col(c).cast("string")
    none = F.array().cast("array<string>")
    a = artifacts(spark, sf_dir)
    rows = a.select(name("id").alias("id"), F.lit("log/artifact").alias("kind"), "actor", F.when(F.col("parent").isNull(), none).otherwise(F.array(name("parent"))).alias("parents"), F.to_json(F.struct("text")).alias("payload"), F.lit(False).alias("critical"))
    v = latest_views(spark, sf_dir).where("target is not null")
    kind = F.col("event_type")
    label = F.when(kind == "click", "score").when(kind == "purchase", "selection").when((kind == "error") & (F.col("event_id") % 20 == 1), "no-train")
    ids = F.transform("shown", lambda x: x.cast("string"))
    said = F.to_json(F.struct(label.alias("label"), F.when(kind == "click", F.col("value")).alias("value"), F.when(kind == "purchase", F.array(name("target"))).alias("chosen"), F.when(kind == "purchase", ids).alias("shown")))
    gone = (kind == "error") & (F.col("event_id") % 20 == 0)
    notes = v.where(label.isNotNull() | gone).select(name("event_id").alias("id"), F.when(gone, "log/tombstone").otherwise("log/annotation").alias("kind"), name("user_id").alias("actor"), F.array(name("target")).alias("parents"), F.when(gone, "{}").otherwise(said).alias("payload"), gone.alias("critical"))
    lines = event_lines(rows.unionByName(notes).withColumn("at", F.lit("2024-01-01T00:00:00Z")))
    return lines.select(F.lit("log").alias("file"), F.col("id").cast("long").alias("line"), F.col("value").alias("text"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    return e.select(F.col("user_id").alias("candidate"), F.col("k").alias("key"), F.col("value").alias("score"), (F.col("event_type") != "error").alias("accepted"), F.col("event_id").alias("ord"))


def call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a session file, lines by time; clicks call, purchases answer the call of the same number."""
    e = event_rows(spark, sf_dir)
    line = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("file"), line.cast("long").alias("line"), F.col("event_id").alias("id"), (F.col("k") % 10).alias("call_id"), "event_type")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as posts of threads; the handle goes by the conversation's number and the role."""
    c = table(spark, sf_dir, "conversations")
    handle = F.concat(F.col("role"), F.lit("-"), (F.col("conv_id") % 5).cast("string"))
    return c.select("conv_id", "turn", handle.alias("handle"), F.initcap("role").alias("display"), F.lit(None).cast("string").alias("author"), "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role"))
