"""Fill-in-middle: texts cut at two of their unit boundaries and put in another order.

A boundary lies between two adjacent characters, the left of one class and the right of
another, and at the end of a text. A text becomes chunks of CHUNK characters, each read
with the first character of the next one, so that every adjacent pair lies in one chunk:

1. each chunk's boundaries are counted, independently of the others;
2. prefix sums of the counts and of the chunks' lengths give the number of units and tell
   which chunk owns the boundary of each of the two cut ranks;
3. only these two chunks are scanned again, for the places of the two boundaries.

All of it is column expressions over the chunks of a row: no text is moved between tasks,
and the work on a text is linear in its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a chunk.
CHUNK = 4096
#: Units by the classes of the characters on either side of a boundary (regular expressions of one character).
UNITS = {"line": (r"\n", r"[\s\S]"), "word": (r"[ \t-\r]", r"[^ \t-\r]"), "char": (r"[\s\S]", r"[\s\S]")}
SENTINELS = ("<P>", "<S>", "<M>")
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def chunked(rows: DataFrame, text: str, name: str, size: int = CHUNK) -> DataFrame:
    """Adds name, array<struct<body, ahead>>: the text in chunks of so many characters, each with the character that follows it (empty at the end)."""
    # a column of its own, so that no lambda cuts the text again for each chunk
    rows = rows.withColumn(name, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    after = F.slice(name, F.lit(2), F.greatest(F.lit(1), F.size(name)))
    return rows.withColumn(name, F.zip_with(name, after, lambda x, y: F.struct(x.alias("body"), F.coalesce(F.substring(y, 1, 1), F.lit("")).alias("ahead"))))


def _counted(unit: tuple[str, str], part: Column) -> Column:
    return F.regexp_count(F.concat(part["body"], part["ahead"]), F.lit(f"{unit[0]}(?={unit[1]})"))


def _place(unit: tuple[str, str], rank: Column) -> Column:
    """How many characters lie before the boundary of this rank (from 1; 0 is the beginning, n the end). Of the columns parts, before (boundaries before each chunk, array) and at (characters before each chunk)."""
    owner = F.size(F.filter(F.col("__before"), lambda b: b < rank))
    part = F.element_at("__parts", owner)
    pieces = F.split(F.concat(part["body"], part["ahead"]), f"(?<={unit[0]})(?={unit[1]})")
    own = F.slice(pieces, F.lit(1), rank - F.element_at("__before", owner))
    inside = F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return F.when(rank <= 0, F.lit(0).cast("long")).when(rank >= F.col("n"), F.col("__chars")).otherwise(F.element_at("__at", owner) + inside)


def _running(values: Column) -> Column:
    """The sums of the values before each place."""
    start = F.struct(F.array().cast("array<bigint>").alias("all"), F.lit(0).cast("long").alias("sum"))
    # sums of groups of places and then in the groups, so that the work isn't the square of their number
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))), lambda g: F.slice(values, g * size + 1, size))

    def sums(xs: Column, first: Column) -> Column:
        step = lambda s, x: F.struct(F.concat(s["all"], F.array(s["sum"])).alias("all"), (s["sum"] + x).alias("sum"))
        return F.aggregate(xs, F.struct(start["all"].alias("all"), first.alias("sum")), step)

    step = lambda s, xs: F.struct(F.concat(s["all"], F.array(sums(xs, s["sum"])["all"])).alias("all"), F.aggregate(xs, s["sum"], lambda t, x: t + x).alias("sum"))
    nested = F.aggregate(groups, F.struct(F.array().cast("array<array<bigint>>").alias("all"), F.lit(0).cast("long").alias("sum")), step)
    return F.flatten(nested["all"])


def draws(id_: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hex sha256 of seed:id, as integers; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | tuple[str, str] = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50, sentinels: Sequence[str] = SENTINELS, size: int = CHUNK) -> DataFrame:
    """Every row of docs with n (units of its text), form, prefix_chars, middle_chars and output; columns of these names give way.

    The draws h1 to h4 come from the seed and the id alone, so rows that repeat an id are
    cut by the same draws, and a null id draws as an empty one. Prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) units, middle after the larger. form is
    plain (output is the text) where the text is empty or null, holds a sentinel, or
    h3 % 100 >= percent; else spm (suffix, prefix, middle) where h4 % 100 < spm_percent,
    else psm. prefix_chars and middle_chars are null if plain. An empty table gives no rows.
    """
    pair = UNITS[unit] if isinstance(unit, str) else unit
    p, s, m = sentinels
    kept = [c for c in docs.columns if c not in MADE and not c.startswith("__")]
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    rows = chunked(docs.select(*kept).withColumn("__text", F.coalesce(text_col, F.lit(""))), "__text", "__parts", size)
    rows = rows.withColumns({"__counts": F.transform("__parts", lambda x: _counted(pair, x).cast("long")), "__lengths": F.transform("__parts", lambda x: F.length(x["body"]).cast("long"))})
    rows = rows.withColumns({"__before": _running(F.col("__counts")), "__at": _running(F.col("__lengths")), "__chars": F.length("__text").cast("long")})
    inner = F.aggregate("__counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("n", F.when(F.col("__chars") > 0, inner + 1).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumns({"__h1": F.pmod(h1, F.col("n") + 1), "__h2": F.pmod(h2, F.col("n") + 1)})
    rows = rows.withColumns({"__a": F.least("__h1", "__h2").cast("int"), "__b": F.greatest("__h1", "__h2").cast("int")})
    plain = (F.col("__chars") == 0) | (h3 % 100 >= percent)
    for x in sentinels:
        plain |= F.contains("__text", F.lit(x))
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumns({"__p": _place(pair, F.col("__a")), "__q": _place(pair, F.col("__b"))})
    cut = lambda a, b: F.substring(F.col("__text"), (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = cut(F.lit(0), F.col("__p")), cut(F.col("__p"), F.col("__q")), cut(F.col("__q"), F.col("__chars"))
    psm = F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)
    spm = F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)
    output = F.when(F.col("form") == "plain", F.col("__text")).when(F.col("form") == "psm", psm).otherwise(spm)
    moved = F.col("form") != "plain"
    return rows.select(*kept, "n", "form", F.when(moved, F.col("__p")).alias("prefix_chars"), F.when(moved, F.col("__q") - F.col("__p")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that fill_in_middle made this output of."""
    marks = "|".join(r"\Q" + x + r"\E" for x in sentinels)
    parts = F.split(output, marks, -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
