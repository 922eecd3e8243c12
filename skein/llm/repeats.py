"""Removal of repeated strings, exact to the byte, by prefix-free parsing.

A text is a row of suffixes; one is repeated if its first LENGTH bytes also start
elsewhere. The parse works with a rolling hash over TRIGGER bytes: the least hash
among the places where such a window lies inside a suffix's first LENGTH bytes is the
suffix's trigger. It depends on those bytes only, so equal suffixes have equal
triggers, at equal distances. Runs of suffixes with one trigger are the phrases;
neighbours overlap in all but their triggers' distance, which makes the set
prefix-free, and every suffix starts in exactly one phrase.

1. Triggers are counted over the corpus. A phrase whose trigger occurs once holds no
   repeated suffix: most text ends here, with 8 bytes moved for about 50.
2. The phrases left make the dictionary. One that is there twice or more is repeated
   in all its suffixes. The others are cut in sections of at most STEP suffixes, aligned
   to the trigger: one whose whole text recurs is repeated in all its suffixes, one
   whose core (what all its suffixes share) doesn't recur, in none.
3. Only the sections in between, at the ends of repeated stretches, are put in corpus
   order suffix by suffix: by the first LENGTH bytes, under a hash.

An order of equal suffixes is enough here, so ranks are hashes (64 bits of the section
core beside 64 of the string). Counts are aggregated before they are joined back, and
the joins are on hashes; no group of copies meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Tables, checkpointed, release

#: Bytes of a repeated string, of a trigger window, and suffixes of a section.
LENGTH, TRIGGER, STEP = 200, 100, 25
_CHUNK = 1 << 16
_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_CHUNK + TRIGGER, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each window of TRIGGER bytes."""
    n = len(data) - TRIGGER + 1
    out = np.empty(max(n, 0), np.uint64)
    for at in range(0, n, _CHUNK):
        part = data[at : at + _CHUNK + TRIGGER - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        out[at : at + _CHUNK] = (sums[TRIGGER:] - sums[:-TRIGGER]) * _DOWN[: len(part) - TRIGGER + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each width neighbours, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def phrases(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger hash, first suffix, last suffix of each phrase, and whether its trigger recurs nearby; none below LENGTH bytes."""
    if len(data) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    h = rolling_hashes(np.frombuffer(data, np.uint8))
    width = LENGTH - TRIGGER + 1
    least = _sliding(h, width, np.minimum)  # of each suffix that is long enough
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    # places that are the least of some suffix; equal ones near each other lie in one phrase or in two that touch
    top = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(top, width, np.maximum) == h)
    order = np.lexsort((chosen, h[chosen]))
    place, value = chosen[order], h[chosen][order]
    near = (value[1:] == value[:-1]) & (place[1:] - place[:-1] <= 2 * LENGTH)
    return least[first], first, last, np.isin(least[first], value[1:][near])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _count_triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [phrases(_bytes_of(t)) for t in batch.column(0).to_pylist()]
        h = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.uint64)
        again = np.concatenate([f[3] for f in found]) if found else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(1 + again.astype(np.int64))], names=["h", "n"])


def _list_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, row = [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            data = _bytes_of(text)
            h, first, last, _ = phrases(data)
            if len(h):
                view = memoryview(data)
                whole = np.array([xxhash.xxh3_64_intdigest(view[x : y + LENGTH]) for x, y in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                cells.append((h, whole, first, last))
                row += [i] * len(h)
        if row:
            h, whole, first, last = (np.concatenate(c) for c in zip(*cells, strict=True))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(_signed(whole)), *(batch.column(i).take(at) for i in (0, 1)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["h", "whole", "did", "th", "a", "b"])


def sections(data: bytes, wanted: list[tuple]) -> Iterator[tuple[tuple, tuple[int, int, int, int]]]:
    """(phrase, (core hash, whole hash, first suffix, last suffix)) of the sections of phrases (trigger hash, first, last suffix, ...).

    A phrase goes on while the least hash stays equal, so in a text with a short
    period it may hold several places of its trigger; each suffix is aligned to the
    last of them that it holds.
    """
    hashes = rolling_hashes(np.frombuffer(data, np.uint8))
    view, width = memoryview(data), LENGTH - TRIGGER
    for phrase in wanted:
        h, lo, hi = phrase[:3]
        places = (lo + np.flatnonzero(hashes[lo : hi + width + 1] == np.uint64(h))).tolist()
        for j, t in enumerate(places):
            x = max(lo, t - width)
            end = min(hi, t, places[j + 1] - width - 1 if j + 1 < len(places) else hi)
            while x <= end:
                q = min((t - x) // STEP, (width - 1) // STEP)  # suffixes with STEP * q up to STEP * (q + 1) bytes before the trigger
                stop, reach = min(end, t - STEP * q), min(STEP * (q + 1), width)
                core = view[t - STEP * q : t + LENGTH - reach]
                yield phrase, (xxhash.xxh3_64_intdigest(core, q), xxhash.xxh3_64_intdigest(view[x : stop + LENGTH], q), x, stop)
                x = stop + 1


def _list_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for did, th, text, open_ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            data = _bytes_of(text)
            for (_, _, _, n), found in sections(data, [(s["h"] % (1 << 64), s["a"], s["b"], s["n"]) for s in open_]):
                rows.append((*found, did, th, n))
        if rows:
            core, whole, a, b, did, th, n = zip(*rows, strict=True)
            hashes = [pa.array(_signed(np.array(x, np.uint64))) for x in (core, whole)]
            yield pa.RecordBatch.from_arrays([*hashes, pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], names=["core", "whole", "did", "th", "a", "b", "n"])


def _list_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for did, th, text, open_ in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            view = memoryview(_bytes_of(text))
            rows += [(s["core"], xxhash.xxh3_64_intdigest(view[x : x + LENGTH]), did, th, x, s["n"]) for s in open_ for x in range(s["a"], s["b"] + 1)]
        if rows:
            core, suffix, did, th, at, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(_signed(np.array(suffix, np.uint64))), pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["core", "suffix", "did", "th", "at", "n"])


def repeated_suffixes(keyed: DataFrame) -> DataFrame:
    """did, th, ranges (array of a, b): what the suffixes a..b cover is what the repeated ones do, for each row of keyed (did, th, text); a row without any is absent.

    Rows equal in did, th and text give the same ranges once; they count as often as they are there.
    """
    spark, tables = keyed.sparkSession, Tables(keyed.sparkSession)
    place = F.struct("did", "th", "a", "b")

    def per_text(open_: DataFrame, *cells: str) -> DataFrame:
        """The texts that have something open, with it."""
        lists = open_.groupBy("did", "th").agg(F.collect_list(F.struct(*cells)).alias("open"))
        return keyed.join(lists, ["did", "th"]).select("did", "th", "text", "open")

    counts = keyed.select("text").mapInArrow(_count_triggers, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    listed = keyed.select("did", "th", "text").mapInArrow(_list_phrases, "h long, whole long, did long, th long, a int, b int")
    # a trigger that is there twice may be so in one phrase only
    found = tables.write(listed.join(counts.where("n > 1").select("h"), "h"))
    del counts, listed
    release(spark)
    by_whole = found.groupBy("h", "whole").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    kinds = tables.write(by_whole.join(by_whole.groupBy("h").agg(F.count("*").alias("kinds")), "h"))
    again = tables.write(found.join(kinds.where("n > 1").select("h", "whole"), ["h", "whole"]).select("did", "th", "a", "b"))
    del by_whole, found
    release(spark)
    # one phrase of each kind, where it may share suffixes with others or with itself
    open_ = kinds.where("kinds > 1 or n = 1").select("h", "n", "one.*")
    parts = tables.write(per_text(open_, "h", "a", "b", "n").mapInArrow(_list_sections, "core long, whole long, did long, th long, a int, b int, n long"))
    del kinds, open_
    release(spark)
    by_whole = parts.groupBy("core", "whole").agg(F.sum("n").alias("n"), F.min(place).alias("one"))
    kinds = tables.write(by_whole.join(by_whole.groupBy("core").agg(F.count("*").alias("kinds")), "core").where("n > 1 or kinds > 1"))
    alike = parts.where("n = 1").join(kinds.where("n > 1").select("core", "whole"), ["core", "whole"]).select("did", "th", "a", "b")
    again = again.unionByName(alike)
    suffixes = tables.write(per_text(kinds.where("kinds > 1").select("core", "n", "one.*"), "core", "a", "b", "n").mapInArrow(_list_suffixes, "core long, suffix long, did long, th long, at int, n long"))
    del by_whole, kinds, alike
    release(spark)
    twice = suffixes.groupBy("core", "suffix").agg(F.sum("n").alias("n")).where("n > 1").select("core", "suffix")
    single = suffixes.where("n = 1").join(twice, ["core", "suffix"]).select("did", "th", F.col("at").alias("a"), F.col("at").alias("b"))
    ranges = again.unionByName(single).groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    ranges = checkpointed(ranges.mapInArrow(_united, "did long, th long, ranges array<struct<a:int,b:int>>"))
    tables.drop()
    del parts, suffixes, again, twice, single
    release(spark)
    return ranges


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges whose covers touch become one; in order."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        rows = []
        for ranges in batch.column(2).to_pylist():
            out: list[dict] = []
            for a, b in sorted((r["a"], r["b"]) for r in ranges):
                if out and a <= out[-1]["b"] + LENGTH:
                    out[-1]["b"] = max(out[-1]["b"], b)
                else:
                    out.append({"a": a, "b": b})
            rows.append(out)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["did", "th", "ranges"])


def cut_out(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the bytes that the suffixes a..b cover, how many go, in how many runs."""
    kept, removed, runs, at = [], 0, 0, 0
    start = end = 0
    for a, b in [*sorted(ranges), (len(data) + 1, len(data) + 1)]:
        if a > end:
            if end > start:
                kept.append(data[at:start])
                removed, runs, at = removed + end - start, runs + 1, end
            start = a
            end = b + LENGTH
        end = max(end, b + LENGTH)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the bytes left) of every row.

    Texts are UTF-8 bytes, null is empty. Every byte goes that a string of LENGTH
    bytes covers which starts twice or more, in one row or in several, judged on the
    input. Rows are told apart by id and text; rows equal in both count as two. A null
    id is kept. Bytes left need not be valid UTF-8.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    ranges = repeated_suffixes(keyed.select("did", "th", "text"))
    joined = keyed.join(ranges, ["did", "th"], "left").select("doc_id", "text", "ranges")
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = _bytes_of(text)
                kept, removed, runs = cut_out(data, [(r["a"], r["b"]) for r in found or ()])
                rows.append((doc, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept)[: 5 + with_text])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 + with_text]
            cells = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=[x.split()[0] for x in shape.split(", ")])

    return joined.mapInArrow(run, shape)
