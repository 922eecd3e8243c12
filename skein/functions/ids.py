"""Deterministic identities and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_id(*parts: Column) -> Column:
    """UUID (version 8) of the first 16 bytes of SHA-256 over the parts, each followed by a NUL."""
    joined = F.concat(*(x for p in parts for x in (p.cast("string"), F.lit("\0"))))
    h = F.sha2(joined, 256)
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def line_digest(line: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(line, 256))


def with_digest(line: Column) -> Column:
    """A compact JSON object with its digest as the last member."""
    return F.concat(F.substr(line, F.lit(1), F.length(line) - 1), F.lit(',"digest":"'), line_digest(line), F.lit('"}'))
