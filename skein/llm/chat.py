"""Chat formatting with offset-aligned loss masks.

A conversation becomes one string of turns

    <turn:ROLE>
    TEXT</turn>

(a line feed after each). In TEXT a backslash is written as two and `<` as `\\<`, so
that no control string can come from a text; in ROLE `>` and line feeds are escaped
too. The string is encoded once, with the character offsets of its tokens, and the
sorted spans of the turns that bear loss are intersected with the token spans by
binary search: mask holds, for each token that meets such a span, the part that does.
read_back() gets turns and loss text from the formatted string and the mask alone.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLES = ("assistant",)
_UNESCAPE = re.compile(r"\\([\\<>n])")
_TURN = re.compile(r"<turn:((?:[^<>\\\n]|\\[\\<>n])*)>\n((?:[^<\\]|\\[\\<])*)</turn>\n")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\>").replace("\n", "\\n")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


class Formatted(NamedTuple):
    text: str
    spans: np.ndarray  # start and end of the text of each loss turn, in order
    ids: np.ndarray
    offsets: np.ndarray  # start and end of each token
    mask: np.ndarray  # token, start, end: the part of a token that bears loss


def render(turns: Sequence[tuple[str, str]], loss_roles: Sequence[str] = LOSS_ROLES) -> tuple[str, np.ndarray]:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn:{escape_role(role)}>\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def intersect(spans: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (token, start, end): what each token shares with the spans; both are sorted, spans are disjoint."""
    if not len(spans) or not len(offsets):
        return np.empty((0, 3), np.int64)
    # tokens that end after a span's start and start before its end
    first = np.searchsorted(np.maximum.accumulate(offsets[:, 1]), spans[:, 0], side="right")
    stop = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    count = np.maximum(stop - first, 0)
    which = np.repeat(np.arange(len(spans)), count)
    token = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    start = np.maximum(offsets[token, 0], spans[which, 0])
    end = np.minimum(offsets[token, 1], spans[which, 1])
    return np.stack([token, start, end], 1)[start < end]


def encode(tokenizer, turns: Sequence[tuple[str, str]], loss_roles: Sequence[str] = LOSS_ROLES) -> Formatted:
    text, spans = render(turns, loss_roles)
    found = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
    return Formatted(text, spans, np.array(found.ids, np.int64), offsets, intersect(spans, offsets))


def read_back(text: str, mask: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """The turns of a formatted string, and all text under the mask, unescaped. Tokens that share a character count it once."""
    turns = [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
    parts, end = [], 0
    for _, a, b in mask.tolist():
        if b > end:
            parts.append(text[max(a, end) : b])
            end = b
    return turns, unescape("".join(parts))


_SCHEMA = "conv_id long, formatted string, ids array<int>, mask array<struct<token:int,start:long,end:long>>"


def format_conversations(rows: DataFrame, tokenizer_path: str, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """One row for each conv_id: formatted, ids, mask (token, and the characters of it under the loss, end exclusive).

    rows: conv_id, turn, role, text, a row to each turn, in any order. Turns go by
    turn, null first, then by role and text. A null role or text counts as empty, a
    null conv_id is a conversation of its own. Other columns are ignored; an empty
    table gives no rows. Rows of a conversation are read as a sorted stream, so a task
    holds one conversation at a time (that has to be held, as it becomes one string).
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    tokenizer_json = Path(tokenizer_path).read_text()  # executors need no file
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(tokenizer_json)
        tokenizer.encode_special_tokens = True
        kind = pa.list_(pa.struct([("token", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

        def out(conv: int | None, turns: list[tuple[str, str]]) -> pa.RecordBatch:
            f = encode(tokenizer, turns, loss_roles)
            mask = [dict(zip(("token", "start", "end"), m, strict=True)) for m in f.mask.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([f.text]), pa.array([f.ids.tolist()], pa.list_(pa.int32())), pa.array([mask], kind)], names=["conv_id", "formatted", "ids", "mask"])

        now, held = None, []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and conv != now:
                    yield out(now, held)
                    held = []
                now = conv
                held.append((role, text))
        if held:
            yield out(now, held)

    return turns.mapInArrow(run, _SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and masks hold, read back from them."""
    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in shape.split(", ")]
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns, loss = read_back(text, np.array([[m["token"], m["start"], m["end"]] for m in mask], np.int64).reshape(-1, 3))
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
                rows.append((conv, len(turns), sha[0], len(loss), sha[1], len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cells = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, shape)
