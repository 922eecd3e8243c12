"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's
target over its size. The expected copies are prefix-summed over the source's
documents, one offset in [0, 1) is added, and a document is emitted once for each
integer boundary that the running sum crosses in it. Documents are taken in order of
size class, so that the words taken stay near the target and not only the copies.

The prefix sum over a source of any size is done in two steps: counts for each
(source, size class, salt), which partial aggregation makes small, are summed into
offsets, and documents are numbered inside their small group only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import checkpointed

#: Of the source names in code point order, null last; the budget as a share of all sizes; the most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: A word: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Words wanted of each source: share * all words by weight, no more than most times a source's own; what is cut off goes to the others by weight.

    Sources stop in order of their limit over their weight, so one pass finds all that do.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_weight = share * sum(sizes.values()), sum(weight.values())
    out = {}
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):
        if most * sizes[s] * open_weight <= left * weight[s]:
            out[s] = float(most * sizes[s])
            left, open_weight = left - most * sizes[s], open_weight - weight[s]
        else:
            out[s] = weight[s] * left / open_weight
    return out


def offset(source: str | None, seed: int) -> float:
    """In [0, 1), from the source's name."""
    return int(hashlib.md5(f"{seed}:{'' if source is None else '=' + source}".encode()).hexdigest()[:8], 16) / 2.0**32


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns in keep (all unless given), and size, source_size, target, copies, taken for every row.

    size counts words of the whole text (null: 0). copies is 0, 1 or 2 under the
    default; taken = copies * size. Rows that repeat an id count on their own. A
    source without words has target 0. An empty table gives no rows. Columns of the
    input that are called like the new ones are replaced. What is collected is one row
    for each source.
    """
    spark = docs.sparkSession
    new = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in (keep or docs.columns) if c not in new]
    digits = F.col("size").cast("string")
    key = ["__source", "__class", "__salt"]
    rows = docs.withColumn("size", word_count(text_col)).select(
        *kept,
        "size",
        F.col(source_col).alias("__source"),
        (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).alias("__class"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("__order"),
    ).withColumn("__salt", F.substring("__order", 1, 1))
    groups = checkpointed(rows.groupBy(*key).agg(F.count("*").alias("__n"), F.sum("size").alias("__words")))
    sizes = {r[0]: r[1] for r in groups.groupBy("__source").agg(F.sum("__words")).collect()}
    wanted = targets(sizes, weights, share, most)
    table = [(s, n, wanted[s], wanted[s] / n if n else 0.0, offset(s, seed)) for s, n in sizes.items()]
    table = spark.createDataFrame(table, "__s string, source_size long, target double, __rate double, __offset double")
    before = F.sum("__n").over(Window.partitionBy("__source").orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select(*(F.col(k).alias(f"{k}2") for k in key), F.coalesce(before, F.lit(0)).alias("__start"))
    starts = starts.join(table, F.col("__source2").eqNullSafe(F.col("__s")))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("size", "__order", id_col, *([text_col] if text_col in kept else [])))
    numbered = rows.withColumn("__place", place)
    same = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in key]
    i = F.col("__start") + F.col("__place")
    crossed = lambda n: F.floor(F.col("__offset") + n * F.col("__rate"))
    out = numbered.join(starts, same[0] & same[1] & same[2]).withColumn("copies", F.least(crossed(i) - crossed(i - 1), F.lit(most)).cast("int"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*kept, *new)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say."""
    return mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("__copy")
