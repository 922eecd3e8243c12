"""Text expressions. Patterns spell out ASCII classes, so that every engine reads them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a trim of the source format takes off, beyond the ASCII kinds.
SPACE = r"[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}]"


#: A few ranges that hold all of SPACE but blank, tab and line feed, and little else: what has none of them takes a faster way.
RARE = r"[\x0B\f\r\x{00A0}\x{1680}-\x{3000}\x{FEFF}]"


def trim(text: Column) -> Column:
    # an end's run of white space is tried once, from its first place
    any_space = F.regexp_replace(text, f"^{SPACE}++|(?<!{SPACE}){SPACE}++$", "")
    return F.when(text.rlike(RARE), any_space).otherwise(F.btrim(text, F.lit(" \t\n")))


def is_retweet(text: Column) -> Column:
    """RT as a word at the start."""
    return text.rlike("^RT($|[^A-Za-z0-9_])")


def is_quoted_retweet(text: Column) -> Column:
    """The stricter test: RT, a handle and a colon."""
    return text.rlike("^RT @[A-Za-z0-9_]+:")


def utf16_length(text: Column) -> Column:
    """Characters beyond the basic plane count two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def long_enough(text: Column, least: int) -> Column:
    return F.lit(True) if least <= 0 else utf16_length(trim(text)) >= least


def clean(text: Column, urls: Column | None = None) -> Column:
    """Expand urls (array of url, expanded_url), drop short links, mentions and hashtags, tidy white space."""
    if urls is not None:
        text = F.aggregate(urls, text, lambda t, u: F.replace(t, u["url"], u["expanded_url"]))
    text = F.regexp_replace(text, "\r\n?", "\n")
    for gone in (r"https://t\.co/[A-Za-z0-9_]+", r"@[A-Za-z0-9_.-]+", "#[A-Za-z0-9_]+"):
        text = F.regexp_replace(text, gone, "")
    text = F.regexp_replace(text, "[ \t]+", " ")
    lines = F.array_join(F.transform(F.split(text, "\n"), trim), "\n")
    text = F.when(text.rlike(RARE), lines).otherwise(F.regexp_replace(text, " ?\n ?", "\n"))
    return trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def file_stem(text: Column, most: int = 50) -> Column:
    """Letters, digits, `_`, `-`; white space becomes `_`; never empty."""
    kept = F.regexp_replace(trim(F.regexp_replace(text, "[^A-Za-z0-9_ -]", "")), " +", "_")
    return F.coalesce(F.nullif(F.substring(kept, 1, most), F.lit("")), F.lit("untitled"))


def slug(text: Column, words: int = 5) -> Column:
    return file_stem(F.array_join(F.slice(F.split(text, r"\s+"), 1, words), " "))


def character_id(name: Column, most: int = 64) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(kept, "^_|_$", ""), 1, most), F.lit("")), F.lit("unknown"))


def permalink(source: Column, item_id: Column, handle: Column) -> Column:
    """Where an item can be seen; null for other sources."""
    at = F.regexp_extract(item_id, "^at://([^/]+)/[^/]+/([^/]+)$", 1)
    key = F.regexp_extract(item_id, "^at://([^/]+)/[^/]+/([^/]+)$", 2)
    return (
        F.when(source.startswith("twitter:"), F.concat(F.lit("https://twitter.com/"), F.coalesce(F.nullif(handle, F.lit("")), F.lit("i")), F.lit("/status/"), item_id))
        .when(source.startswith("bluesky:") & (at != ""), F.concat(F.lit("https://bsky.app/profile/"), at, F.lit("/post/"), key))
    )


def system_prompt(display: Column, character: Column, handle: Column) -> Column:
    shown = F.when(F.coalesce(handle, F.lit("")) != "", F.concat(F.lit(" ("), handle, F.lit(")"))).otherwise("")
    return F.concat(F.lit("You are "), F.coalesce(F.nullif(display, F.lit("")), character), shown, F.lit("."))


def html_to_markdown(html: Column) -> Column:
    """Documented rules: script, style and head go; breaks and paragraphs become lines; emphasis and links keep their marks; tags go; entities are read."""
    out = F.regexp_replace(html, "(?is)<(script|style|head)[^>]*>.*?</(script|style|head)>", "")
    out = F.regexp_replace(out, "(?i)<br[^>]*>", "\n")
    out = F.regexp_replace(out, "(?i)</(p|div|h[1-6]|li|ul|ol|blockquote|tr)>", "\n\n")
    out = F.regexp_replace(out, "(?i)</?(em|i)>", "*")
    out = F.regexp_replace(out, "(?i)</?(strong|b)>", "**")
    out = F.regexp_replace(out, '(?i)<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)")
    out = F.regexp_replace(out, "<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return trim(F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), " ?\n[ \n]*\n", "\n\n"))


def audit_value(value: Column, most: int = 200) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("…"))).otherwise(value)


def isolate_links(text: Column) -> Column:
    """Links to posts stand in paragraphs of their own; other blanks, also those at the ends, stay. A link ends before a bracket or white space; null stays null."""
    gap = SPACE[:-1] + r"&&[^\n]]"
    link = r"https?://(?:www\.)?(?:twitter|x)\.com/[A-Za-z0-9_]+/status/[0-9]+(?:\?[^)" + SPACE[1:] + "*+)?"
    text = F.regexp_replace(text, f"({link})", "\n$1\n")
    # now a link fills its line, or what follows it begins the next one
    text = F.regexp_replace(text, f"(?md)^{gap}*+({link}){gap}*+$", "$1")
    # a line that says something, then a link; a link, then such a line
    text = F.regexp_replace(text, f"({SPACE.replace('[', '[^', 1)}{gap}*+\n)(?={link}(?:\n|\\z))", "$1\n")
    text = F.regexp_replace(text, f"(?md)(^{link}\n)(?={gap}*+[^\n{SPACE[1:]})", "$1\n")
    return F.regexp_replace(text, "\n{3,}", "\n\n")
