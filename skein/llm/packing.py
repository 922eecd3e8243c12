"""Packing documents into sequences: shortest-pack-first over the length histogram.

A document's ids are cut into full sequences and a rest. The rests' lengths make a
histogram of at most LENGTH - 1 bins, whatever the number of documents; lengths are
placed longest first, each into the open patterns with the most room (the shortest
packs), whole counts of sequences at a time. The pattern counts are then joined back to
the pieces by their rank among those of equal length.

Tokens are found piece by piece: the tokenizer's splits are independent, so the ids of
the distinct pieces of some texts are looked up, and only new pieces are encoded.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import checkpointed

#: Tokens in a sequence; the id that ends a document; pieces of one length that are ranked together.
LENGTH, END, GROUP = 4096, 2, 500
#: Pieces of words whose ids a worker remembers, and places (a power of two) that tell whether one was met before.
REMEMBERED, MET = 200_000, 1 << 20
#: Characters whose pieces a worker looks up at once.
PORTION = 1 << 19

_SPACE, _LETTER, _NUMBER, _SIGN = range(4)
_CLASS = np.array([_SPACE if chr(c).isspace() else _LETTER if chr(c).isalpha() else _NUMBER if chr(c).isnumeric() else _SIGN for c in range(0x300)], np.uint8)
_OTHER = re.compile("[^\x00-˿]")
#: The character that the tokenizer's model has for each byte: its own, or one from U+0100 on for those that do not print.
_OWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = [chr(b if b in _OWN else 0x100 + sum(c not in _OWN for c in range(b))) for b in range(256)]


def spaced(text: str) -> str:
    """A lower-case text below U+0300 with a space at each place where the tokenizer splits inside a word (between white space).

    Its pieces are runs of letters, single numbers, runs of signs, and a quote with s, t,
    m, d, re, ve or ll behind it, where the quote starts a piece.
    """
    units = np.frombuffer(text.encode("utf-16-le"), "<u2")
    kind = _CLASS[units]
    cut = np.zeros(len(units) + 3, bool)  # whether a piece starts at a unit that no space precedes
    left, right = kind[:-1], kind[1:]
    cut[1 : len(units)] = ((left != right) | (right == _NUMBER)) & (left != _SPACE) & (right != _SPACE)
    quotes = np.flatnonzero(units == ord("'"))
    if len(quotes):
        quotes = quotes[(quotes == 0) | (kind[quotes - 1] != _SIGN)]
        after = np.pad(units, (0, 3))
        a, b = after[quotes + 1], after[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (np.isin(a, [ord(c) for c in "rv"]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        space = np.pad(kind == _SPACE, (0, 3), constant_values=True)
        for at, n in ((quotes[one], 1), (quotes[two], 2)):
            cut[at + 1] = False
            cut[at + n + 1] = ~space[at + n + 1]
    return np.insert(units, np.flatnonzero(cut), ord(" ")).tobytes().decode("utf-16-le")


class WordEncoder:
    """The ids of the lower-casing word tokenizer, by remembered pieces: a piece to its ids' bytes.

    Below U+0300 that tokenizer's normalisation is lower-casing, and its splits are those
    of spaced and white space. So Arrow splits texts and finds their distinct pieces, and
    the tokenizer's model encodes those that are new. A text with any other character,
    with a control character that only some call white space, or with a special token's
    opening is encoded as a whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}  # known when the memory was half full
        self.met = bytearray(MET)  # by a piece's hash; pieces of equal hash share a place

    def _ids(self, names: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        known, before, met, mask = self.known, self.before, self.met, len(self.met) - 1
        tokenize = self.model.tokenize
        found = list(map(known.get, names))
        for i, data in enumerate(found):
            if data is None:
                name = names[i]
                found[i] = data = before.get(name)
                if data is None:
                    shown = name if name.isascii() and name.isprintable() else "".join([_SHOWN[b] for b in name.encode()])
                    found[i] = data = array("I", [t.id for t in tokenize(shown)]).tobytes()
                    # most pieces of a large corpus come once: one is remembered when it is met again
                    place = hash(name) & mask
                    if not met[place]:
                        met[place] = 1
                        continue
                known[name] = data
        if len(known) > REMEMBERED // 2:
            self.known, self.before, self.met = {"": b""}, known, bytearray(len(met))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        lows, wholes = [], {}
        for i, text in enumerate(texts):
            low = text.lower()
            if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f") or not low.isascii() and _OTHER.search(low):
                wholes[i], low = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32), ""
            lows.append(low)
        # no text that is left has the separator
        words = pc.utf8_split_whitespace(pa.array(spaced("\x1c".join(lows)).split("\x1c"), pa.large_string()))
        pieces = words.flatten().dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        _, stops, data = pa.array(self._ids(names), pa.large_binary()).take(pieces.indices).buffers()
        stops = np.frombuffer(stops, np.int64)[words.offsets.to_numpy()] // 4
        ids = np.frombuffer(data, np.uint32, stops[-1]) if stops[-1] else np.empty(0, np.uint32)
        return [wholes.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True))]


def portions(texts: list[str], chars: int = PORTION) -> Iterator[list[str]]:
    """The texts in order, some at a time: up to chars characters, or one text."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


@lru_cache(1)
def encoder_of(tokenizer_json: str) -> WordEncoder:
    """A worker keeps its encoder from task to task."""
    return WordEncoder(tokenizer_json)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(piece length, pieces)]): every piece of the histogram once, none over length.

    Lengths go longest first, and each piece into the shortest pack, the one with the
    most room, if that holds it; else it opens a new one. Packs of equal room take a
    piece each in one step, so the steps go by the patterns and not by the pieces; a
    pattern used for some of its packs is split in two.
    """
    room: list[int] = []  # of open patterns, sorted
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(space: int, count: int, pieces: list[tuple[int, int]]) -> None:
        if not count:
            return
        if not space:
            done.append((count, pieces))
            return
        if space not in open_:
            insort(room, space)
            open_[space] = []
        open_[space].append((count, pieces))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and room and room[-1] >= size:
            space = room.pop()
            for count, pieces in open_.pop(space):
                use = min(count, left)
                left -= use
                put(space, count - use, pieces)
                again = bool(pieces) and pieces[-1][0] == size
                put(space - size, use, [*pieces[:-1], (size, pieces[-1][1] + 1)] if again else [*pieces, (size, 1)])
        if left:
            each = length // size
            put(length - each * size, left // each, [(size, each)])
            if left % each:
                put(length - left % each * size, 1, [(size, left % each)])
    return done + [p for s in room for p in open_[s]]


def layout(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (piece length, first rank, end rank, pieces in each sequence, first sequence, offset)."""
    rows, rank, sequence = [], {}, 0
    for count, pieces in patterns:
        offset = 0
        for size, each in pieces:
            first = rank.get(size, 0)
            rank[size] = first + count * each
            rows.append((size, first, rank[size], each, sequence, offset))
            offset += size * each
        sequence += count
    return rows


def tokenized(docs: DataFrame, tokenizer_json: str, text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of every row: its other columns, start, length, doc_tokens, ids (binary, little-endian 32 bits); null texts are empty."""
    new = ("start", "length", "doc_tokens", "ids")
    kept = [c for c in docs.columns if c != text_col and c not in new]
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_json)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            row, cells = [], ([], [], [], [])
            for i, ids in enumerate(x for some in portions(texts) for x in encoder.encode(some)):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    row.append(i)
                    for c, x in zip(cells, (at, len(piece), len(ids), piece.tobytes()), strict=True):
                        c.append(x)
            held = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in kept]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, pa.int64()) for c in cells[:3]), pa.array(cells[3], pa.binary())], names=[*kept, *new])

    return docs.select(*kept, text_col).mapInArrow(run, ", ".join([*shape, "start long, length long, doc_tokens long, ids binary"]))


def pack(pieces: DataFrame, order: list[str], length: int = LENGTH) -> DataFrame:
    """Adds sequence_id and offset to pieces (start, length and any other columns).

    order names columns that tell pieces apart; pieces equal in all of them change
    places freely. Pieces of the full length get sequences of their own after the
    packed ones. Give it a table that is read twice at little cost. What is collected
    is the histogram: one row for each length.
    """
    spark = pieces.sparkSession
    total = pieces.groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in total if r["length"]}
    full = counts.pop(length, 0)
    patterns = shortest_pack_first(counts, length)
    first_full = sum(c for c, _ in patterns)
    rows = layout(patterns) + ([(length, 0, full, 1, first_full, 0)] if full else [])
    # at most a few rows for each length: bounded by the sequence length, not by the data
    table = spark.createDataFrame(rows, "__length long, __from long, __to long, __each long, __sequence long, __offset long")
    salts = spark.createDataFrame([(r["length"], -(-r["count"] // GROUP)) for r in total], "__salted long, __groups long")
    # likewise one row for each length
    spread = pieces.join(F.broadcast(salts), F.col("length") == F.col("__salted"))
    spread = spread.withColumn("__group", F.pmod(F.xxhash64(*order), F.col("__groups"))).drop("__salted", "__groups")
    sizes = spread.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("length").alias("__l"), F.col("__group").alias("__g"), F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("length", "__group").orderBy(*order)) - 1
    ranked = spread.withColumn("__place", place).join(starts, (F.col("length") == F.col("__l")) & (F.col("__group") == F.col("__g")))
    rank = F.col("__before") + F.col("__place")
    ranked = ranked.withColumn("__rank", rank)
    fits = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    at = F.col("__rank") - F.col("__from")
    out = ranked.join(F.broadcast(table), fits)
    out = out.withColumn("sequence_id", F.expr("__sequence + (__rank - __from) div __each")).withColumn("offset", F.col("__offset") + at % F.col("__each") * F.col("length"))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, length of every sequence, from packed pieces that kept their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32 (and ids), sequence_id, offset for every piece of every row.

    Null texts count as empty and are one token, the end. A null id is kept. Rows that
    repeat an id are packed on their own. An empty table gives no rows.
    """
    found = tokenized(docs.select(id_col, text_col), Path(tokenizer_path).read_text(), text_col, length, end)
    found = found.withColumn("ids_crc32", F.crc32("ids"))
    found = checkpointed(found if with_ids else found.drop("ids"))
    return pack(found, [id_col, "start", "doc_tokens", "ids_crc32"], length)
