"""Times: ISO strings stay as they are, timestamps are derived; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
#: Milliseconds of the first moment that post ids count from, and the least id that holds a time.
SNOWFLAKE_EPOCH, SNOWFLAKE_FROM = 1288834974657, 1 << 40
#: Other forms that are read, in this order.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM dd, yyyy  h:mm a", "MMM dd HH:mm:ss Z yyyy")


def is_rfc3339(text: Column) -> Column:
    return F.coalesce(text.rlike(RFC3339), F.lit(False))


def parse(text: Column) -> Column:
    """A timestamp in UTC, or null."""
    plain = F.regexp_replace(text, "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ", "")
    return F.coalesce(F.when(is_rfc3339(text), F.try_to_timestamp(text)), *(F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS))


def normalised(text: Column, fallback: Column) -> Column:
    """Struct (at, rule): RFC 3339 as it is, other readable times as ISO, else the fallback."""
    at = parse(text)
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.struct(
        F.when(is_rfc3339(text), text).when(at.isNotNull(), iso).otherwise(fallback).alias("at"),
        F.when(is_rfc3339(text), "verbatim").when(at.isNotNull(), "parsed").otherwise("fallback").alias("rule"),
    )


def snowflake_time(post_id: Column) -> Column:
    i = post_id.cast("long")
    return F.when(i >= SNOWFLAKE_FROM, F.timestamp_millis(F.shiftright(i, 22) + SNOWFLAKE_EPOCH))


def anchor_date(html: Column) -> Column:
    """The English date in an embed's last anchor, as midnight UTC."""
    text = F.regexp_extract(html, r">([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})</a>", 1)
    return F.try_to_timestamp(text, F.lit("MMMM d, yyyy"))


def ladder(post_id: Column, html: Column, cached_at: Column, fallback: Column) -> Column:
    """Struct (at, rung): the id's time, the anchor's date, the cache's time, the fallback."""
    steps = [("snowflake", snowflake_time(post_id)), ("html_date", anchor_date(html)), ("cached_at", F.when(is_rfc3339(cached_at), F.try_to_timestamp(cached_at)))]
    rung = F.lit("fallback")
    for name, at in reversed(steps):
        rung = F.when(at.isNotNull(), name).otherwise(rung)
    return F.struct(F.coalesce(*(a for _, a in steps), fallback).alias("at"), rung.alias("rung"))
