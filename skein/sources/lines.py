"""Numbered lines of text files of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.tables import checkpointed

#: Splits whose first line numbers may be broadcast (about 100 bytes each); beyond that they are joined by shuffle.
BROADCAST_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file, line, text: every line of the files at or below path, numbered from 1 in its file.

    LF ends a line, and one CR before it goes; blank lines are there and count; an LF at
    the end of a file opens no line, so an empty file has none. Spark splits a large file
    between tasks. A first pass counts the lines of each split; sums over the splits of
    a file give the number that each begins with. The second pass adds a line's place in
    its split. No file has to fit in a task, and texts aren't shuffled up to
    BROADCAST_SPLITS splits (at 128 MB each, 12 TB).

    Both passes have to see the same splits: where the files or the session's split sizes
    change in between, the second one fails and says so. A line with bytes that aren't
    UTF-8 keeps them.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    split = ("file", "block", "part")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "value")
    per = rows.groupBy(*split).agg(F.min("row").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = checkpointed(per.select(*split, (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift")))
    joined = rows.join(F.broadcast(starts) if starts.count() <= BROADCAST_SPLITS else starts, list(split), "left")
    changed = F.raise_error(F.lit("the splits of the files changed while their lines were counted")).cast("long")
    line = F.coalesce(F.col("row") + F.col("shift"), changed)
    return joined.select("file", line.alias("line"), F.regexp_replace("value", "\r$", "").alias("text"))


def line_counts(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file, lines: how many lines each file has; a file without any has no row."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("lines"))
