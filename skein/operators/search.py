"""Literal search over message texts: trigram postings narrow, the exact text decides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, DEFAULT = 3, 10_000, 50


def trigrams(text):
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _checked(query: str, limit: int) -> None:
    if len(query) < LEAST:
        raise ValueError(f"a query has at least {LEAST} characters")
    if not 1 <= limit <= MOST:
        raise ValueError(f"a limit is from 1 to {MOST}")


def literal(rows: DataFrame, query: str, order: Sequence[str], limit: int = DEFAULT, text: str = "text") -> DataFrame:
    """Rows whose text holds the query, case-sensitive, in order."""
    _checked(query, limit)
    return rows.where(F.contains(F.col(text), F.lit(query))).orderBy(*order).limit(limit)


def postings(rows: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """trigram and key; written once (partitioned by a prefix of the trigram) it serves many searches."""
    return rows.select(*key, F.explode(trigrams(F.col(text))).alias("trigram"))


def by_postings(rows: DataFrame, index: DataFrame, query: str, key: Sequence[str], order: Sequence[str], limit: int = DEFAULT, text: str = "text") -> DataFrame:
    """The same rows as literal(), reading texts only of rows that have all trigrams of the query."""
    _checked(query, limit)
    wanted = sorted({query[i : i + 3] for i in range(len(query) - 2)})
    have = index.where(F.col("trigram").isin(wanted)).groupBy(*key).agg(F.countDistinct("trigram").alias("n")).where(F.col("n") == len(wanted))
    return literal(rows.join(have.select(*key), list(key), "left_semi"), query, order, limit, text)


def public_segments(blocks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Blocks (type, text) of the public kinds, text not blank, once for each place."""
    public = F.col("type").isin("text", "input_text", "output_text")
    return blocks.where(public & (F.trim("text") != "")).dropDuplicates(list(order))
