"""Personal data in texts: patterns propose, validators confirm, nearby words adjust the score.

Everything is made of built-in column functions. A pattern's matches and the text
between them come from regexp_extract_all and split; their lengths, summed up, are the
positions (code points, end exclusive). The patterns are written so that Java's
matcher neither backtracks nor recurses over long texts: quantifiers are possessive
where giving back could not help, and a match may begin inside a run of its own first
characters only where the match before it ended.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # for Java's matcher
    needs: str  # a cheap pattern that any text with a match holds
    context: str  # words that raise the score, in a text in lower case
    base: float  # score of a confirmed match without such words
    always: bool  # kept whatever its score


#: Characters of an IBAN by country: the registry's, then those in use beside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG CV", 25: "LY PT ST AO GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM CF CG CM GA GQ KM MG TD",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An IBAN of its country's length, so that it ends before a word in capitals or another IBAN; else of any length, up to where one of a known country may begin."""
    known = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
    group = f"(?:\\x20(?!(?:{known})(?![A-Za-z0-9])))?[A-Z0-9]"
    return f"(?<![A-Za-z0-9])(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?:{group}{{4}}){{2,7}}(?:{group}{{1,3}})?)(?![A-Za-z0-9])"


#: In the order in which spans are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", "mail|contact|reach|write", 0.9, True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]+\.[0-9]", r"\bip\b|address|host|server|login", 0.6, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", "card|visa|credit|payment|amex", 0.8, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile|fax", 0.7, True),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2}", r"iban|bank|account|konto|compte|cuenta", 0.8, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", r"ssn|social|security", 0.3, False),
)
#: Characters on either side in which context words are looked for; what they add; the score from which other kinds are kept.
WINDOW, CONTEXT_ADDS, KEPT_FROM = 40, 0.3, 0.5
#: A gap that ends in a word of its own for the number after it; words that only join numbers.
OWN_WORD, JOINING = r"\p{L}[\s:#.]*$", r"(?i)(?<!\p{L})(?:and|or|und|oder|et|ou|y|e|o|u)\s*$"
#: Stands in contexts where one ends; no character of a text.
_END = "\uffff"
BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """Remainder by 97 of an IBAN: the first four characters go last, letters count 10 to 35."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    code = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.when(c < "A", r * 10 + code(c)).otherwise(r * 100 + code(c)) % 97))


def confirmed(kind: str, match: Column) -> Column:
    """What the kind's validator says of a match."""
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(f"^{part}\\.{part}\\.{part}\\.{part}$")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & (mod97(match) == 1)
    if kind == "ssn":
        return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _running(values: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """start, add(start, first), add(add(start, first), second), ... as long as values."""
    state = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, state, lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, though the body, or a lambda in it, names it often."""
    return F.transform(F.array(value), body).getItem(0)


def running_sums(values: Column, add: Callable[[Column, Column], Column] = operator.add) -> Column:
    """The sum (by add, from 0) of what lies before each element of an array of longs; in about sqrt(n) parts, as growing an array copies it."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")

    def parted(v: Column, part: Column) -> Column:
        parts = F.sequence(F.lit(0), F.ceil(F.size(v) / part).cast("int") - 1)
        of = lambda i: F.slice(v, i * part + 1, part)
        sums = F.transform(parts, lambda i: F.aggregate(of(i), zero, add))
        return F.flatten(F.transform(_running(sums, zero, add), lambda at, i: _running(of(i), at, add)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda part: parted(v, part))).otherwise(none))


def spans_of(kind: Kind, text: Column) -> Column:
    """Array of (kind, start, end, score) of the confirmed matches in a text that isn't null.

    Context words are looked for in the WINDOW characters on either side. These reach
    over other matches of the kind, as in a list that is announced once, but not over
    a gap that ends in a word of its own for the match after it.
    """
    matches, between = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)

    def aligned(found: Column, gaps: Column) -> Column:
        # (match, characters between it and the one before); the last gap has no match
        pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("match"), F.length(g).cast("long").alias("gap")))
        return F.filter(pairs, lambda p: p["match"].isNotNull())

    def place(ps: Column) -> Column:
        before = running_sums(F.transform(ps, lambda p: p["gap"] + F.length(p["match"])))
        at = F.zip_with(ps, before, lambda p, b: F.struct(p["match"].alias("match"), (b + p["gap"]).alias("start"), (b + p["gap"] + F.length(p["match"])).alias("end")))
        return F.transform(at, lambda m, i: F.struct(*(m[c].alias(c) for c in ("match", "start", "end")), i.alias("i")))

    def pieces(found: Column, gaps: Column) -> Column:
        # of each gap: what it and the match before, or the match after, are to a context beyond them
        last = lambda c: F.translate(F.substring(c, -WINDOW, WINDOW), _END, " ")
        first = lambda c: F.translate(F.substring(c, 1, WINDOW), _END, " ")
        ends = lambda g: F.when(g.rlike(OWN_WORD) & ~g.rlike(JOINING), _END).otherwise("")
        none = F.array(F.lit(""))
        left = F.zip_with(gaps, F.concat(none, found), lambda g, m: F.concat(last(m), ends(last(g)), last(g)))
        right = F.zip_with(gaps, F.concat(found, none), lambda g, m: F.concat(first(g), ends(last(g)), first(m)))
        return F.struct(left.alias("left"), right.alias("right"))

    def scored(m: Column, p: Column) -> Column:
        # a match has two characters or more: so many pieces cover the window
        reach = WINDOW // 2 + 1
        side = lambda name, start, n: F.array_join(F.slice(p[name], start, n), "")
        left = F.substring_index(side("left", F.greatest(m["i"] + 2 - reach, F.lit(1)), F.least(m["i"] + 1, F.lit(reach))), _END, -1)
        right = F.substring_index(side("right", m["i"] + 2, F.lit(reach)), _END, 1)
        near = F.concat_ws(" ", F.substring(left, -WINDOW, WINDOW), F.substring(right, 1, WINDOW))
        score = F.least(F.lit(kind.base) + F.when(F.lower(near).rlike(kind.context), CONTEXT_ADDS).otherwise(0.0), F.lit(1.0))
        return F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score.alias("score"))

    def spans(found: Column, gaps: Column) -> Column:
        placed = F.filter(let(aligned(found, gaps), place), lambda m: confirmed(kind.name, m["match"]))
        made = lambda ms: let(pieces(found, gaps), lambda p: F.transform(ms, lambda m: scored(m, p)))
        return let(placed, lambda ms: F.when(F.size(ms) > 0, made(ms)).otherwise(F.array().cast(_SPAN)))

    out = let(matches, lambda found: let(between, lambda gaps: spans(found, gaps)))
    out = out if kind.always else F.filter(out, lambda s: s["score"] >= KEPT_FROM)
    return F.when(text.rlike(kind.needs), out).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds spans: array of (kind, start, end, score), kinds in the order of KINDS, then by start.

    Base kinds are those of BASE: every confirmed match stays. The others stay from
    KEPT_FROM on. A null or empty text has none. Rows are independent of each other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("spans", F.concat(*(spans_of(k, text) for k in KINDS)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts and span lists of a table that find() made."""
    of = lambda *k: F.filter("spans", lambda s: s["kind"].isin(*k))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns, every span replaced by its kind in brackets; spans that overlap become one, named by the first. A null text stays null."""
    own = max(docs.columns, key=len) + "_"  # a column spans of the input passes through under this name
    found = find(docs.withColumnRenamed("spans", own), text_col).withColumn("spans", F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.lit(0))))
    text = F.col(text_col)
    cut = lambda a, n: F.substr(text, (a + 1).cast("int"), n.cast("int"))

    def cleaned(spans: Column) -> Column:
        # where what lies before each span ends; a span that starts before that is part of another
        reached = running_sums(F.transform(spans, lambda p: p["end"]), lambda a, b: F.greatest(a, b))
        rows = F.filter(F.zip_with(spans, reached, lambda p, at: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), at.alias("at"))), lambda p: p["start"] >= p["at"])
        named = F.transform(rows, lambda p: F.concat(cut(p["at"], p["start"] - p["at"]), F.lit("["), F.upper(p["kind"]), F.lit("]")))
        end = F.array_max(F.transform(spans, lambda p: p["end"]))
        return F.concat(F.array_join(named, ""), cut(end, F.length(text) - end))

    return found.withColumn(text_col, F.when(F.size("spans") > 0, let(F.col("spans"), cleaned)).otherwise(text)).select(*(F.col(own).alias(c) if c == "spans" else c for c in docs.columns))
