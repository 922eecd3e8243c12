"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles and difference hashes.

decode() reads P1 to P6 (8 or 16 bits a sample, bit and ASCII forms) and
uncompressed BMP of 1, 4, 8, 24 and 32 bits. Anything else, cut short or malformed, or
with a sample above its maximum, gives None: a row of media_features() then has its digests and null features.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a payload are a multiple of this; an image row holds WIDTH of them.
UNIT, WIDTH = 576, 24


def encode_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """Binary greyscale Netpbm of 8-bit samples, width to a row."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _netpbm(data: bytes) -> np.ndarray | None:
    kind, at, fields = data[1:2], 2, []
    for _ in range(2 if kind in b"14" else 3):
        if not (m := _FIELD.match(data, at)):
            return None
        fields.append(int(m[1]))
        at = m.end()
    (w, h), most = fields[:2], fields[2] if len(fields) > 2 else 1
    if not w or not h or not 0 < most < 65536:
        return None
    depth = 3 if kind in b"36" else 1
    if kind in b"123":
        text = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array(list(text.translate(None, b" \t\r\n\v\f")) if kind == b"1" else text.split(), dtype=np.int64)
        out = (values - 48 if kind == b"1" else values)[: w * h * depth]
        if len(out) < w * h * depth:
            return None
        out = out.reshape(h, w, depth)
    elif kind == b"4":
        stride, at = (w + 7) // 8, at + 1
        if len(data) - at < stride * h:
            return None
        out = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride), axis=1)[:, :w, None]
    else:
        at, form = at + 1, np.dtype(">u2" if most > 255 else np.uint8)
        if len(data) - at < w * h * depth * form.itemsize:
            return None
        out = np.frombuffer(data, form, w * h * depth, at).reshape(h, w, depth)
    if out.min() < 0 or out.max() > most:
        return None
    if kind in b"14":
        return ((1 - out.astype(np.uint8)) * 255).astype(np.uint8)
    return out.astype(np.uint8 if most < 256 else np.uint16)


def _bmp(data: bytes) -> np.ndarray | None:
    start, head, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    flipped, h = h > 0, abs(h)
    if packing or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        return None
    stride = (w * bits + 31) // 32 * 4
    if len(data) - start < stride * h:
        return None
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)
    rows = rows[::-1] if flipped else rows
    if bits > 8:
        step = bits // 8
        return np.ascontiguousarray(rows[:, : w * step].reshape(h, w, step)[:, :, 2::-1])
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    table = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    bits_of = np.unpackbits(rows, axis=1).reshape(h, -1, bits)[:, :w]
    index = bits_of @ (1 << np.arange(bits - 1, -1, -1))
    return table[index] if index.max() < len(table) else None


def decode(data: bytes) -> np.ndarray | None:
    """height x width x channels, or None where the bytes aren't such an image."""
    try:
        if re.match(rb"P[1-6]", data):
            return _netpbm(data)
        return _bmp(data) if data[:2] == b"BM" else None
    except (ValueError, OverflowError, struct.error, IndexError):
        return None


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell of a height x width grid laid over the image, by its integral image; cells may cut pixels."""
    h, w = image.shape[:2]
    table = np.zeros((h + 1, w + 1, image.shape[2]))
    np.cumsum(np.cumsum(image, 0, dtype=float), 1, out=table[1:, 1:])

    def cut(t: np.ndarray, n: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * n / parts
        low = np.minimum(at.astype(int), n - 1)
        share = (at - low)[:, None, None]
        return t[low] * (1 - share) + t[low + 1] * share

    lines = cut(table, h, height)
    both = cut(lines.transpose(1, 0, 2), w, width).transpose(1, 0, 2)
    return np.diff(np.diff(both, axis=0), axis=1) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 grid is darker than its right neighbour, row by row."""
    small = area_resize(image.mean(2, keepdims=True), 8, 9)[:, :, 0]
    return int.from_bytes(np.packbits(np.round(small[:, :-1], 6) < np.round(small[:, 1:], 6)).tobytes(), "big")


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """The image resized to side x side, 8 bits a sample, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(np.clip(area_resize(image, side, side), 0, 255)).astype(np.uint8))
    return out.getvalue()


def features(data: bytes, side: int = 16) -> dict:
    image = decode(data)
    if image is None:
        return {"height": None, "width": None, "dhash": None, "tile": None}
    image = image if image.dtype == np.uint8 else (image >> 8).astype(np.uint8)
    return {"height": image.shape[0], "width": image.shape[1], "dhash": f"{difference_hash(image):016x}", "tile": npy_tile(image, side)}


_MEDIA = pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())])


def text_to_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_bytes and media: the text's UTF-8 bytes (null: none), filled with 255 to a positive multiple of UNIT, as a PGM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(_text)
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [(x or "").encode() for x in part.column(place).to_pylist()]
                media = [encode_pgm(t + b"\xff" * (-len(t) % UNIT if t else UNIT)) for t in texts]
                kept = [c for i, c in enumerate(part.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=[*names, "n_bytes", "media"])

    clean = df.drop("n_bytes", "media")
    _text = max(clean.columns, key=len) + "_"  # a name that no column has
    names = [c for c in clean.columns if c != text_col]
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema if f.name != text_col]
    return clean.withColumnRenamed(text_col, _text).mapInArrow(run, ", ".join([*shape, "n_bytes long", "media binary"]))


def media_features(df: DataFrame, media_col: str = "media", side: int = 16) -> DataFrame:
    """Adds height, width, dhash and tile (NPY bytes) of each media cell, and the digests of what is stored and of its samples.

    Null or undecodable media: null features; payload columns are then null too.
    """
    added = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, height int, width int, dhash string, tile binary"
    new = [x.split()[0] for x in added.split(", ")]
    clean = df.drop(*new)
    names = [c for c in clean.columns if c != media_col]
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema if f.name != media_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            place = batch.schema.get_field_index(media_col)
            rows = []
            for data in batch.column(place).to_pylist():
                image = None if data is None else decode(data)
                samples = None if image is None else image.tobytes()
                found = features(data, side) if data is not None else features(b"", side)
                digest = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                inner = (None, None, None) if samples is None else (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]))
                rows.append((*digest, *inner, *(found[n] for n in ("height", "width", "dhash", "tile"))))
            kept = [c for i, c in enumerate(batch.columns) if i != place]
            cells = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, k) for x, k in zip(cells, kinds, strict=True))], names=[*names, *new])

    return clean.mapInArrow(run, ", ".join([*shape, added]))


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts stored as media, read back and described; feature is the difference hash and the digest of the NPY tile."""
    out = media_features(text_to_media(df, text_col))
    return out.withColumn("feature", F.concat_ws(":", "dhash", F.sha2(F.col("tile"), 256)))
