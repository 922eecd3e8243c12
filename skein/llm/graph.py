"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Tables


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, root (the least node of its component) for every node of links (a, b: long); links of a node with itself or null count for nothing, repeated ones once.

    Each round hangs a node's larger neighbours on its least one (large star), then
    its smaller neighbours (small star); rounds grow with the logarithm of the number
    of nodes. A hub's rows are joined to one row of it, which Spark may split. Edges
    lie in tables, those of the round before are dropped. Joins are merge joins: no
    edges pass through the driver.
    """
    tables = tables or Tables(links.sparkSession)
    edges = tables.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, tables.write(small.where("u != v").distinct())
        tables.drop(before)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
