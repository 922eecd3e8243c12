"""Line dedup that can be taken back: sharded cuckoo filters over exact reference-count tables.

The index is a folder of generations. Each names

- references: a row for each line key of each document, one table for each insertion;
- counts: for each key that more than one document holds, how many do and the least id;
- filters: for each shard of the keys, a chain of cuckoo filters that hold each key once,
  also the keys of one document only.

An insertion sums its own keys before they are moved and asks the filters which of them
may have been there before. Only these meet the exact references; a wrong guess of a
filter costs a look and no more. Keys that weren't there go into the filters. A deletion takes references away, counts the touched keys again, and removes keys
that no document holds from their filters. Results come from references and counts, which
are exact, so they are those of an index that never held the deleted documents.

A key is a line with ASCII white space stripped and A-Z lower-cased; it is known by a
128-bit digest.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import checkpointed, shared_folder

#: Buckets of one filter (a power of two), places in a bucket, moves before a filter counts as full.
BUCKETS, SLOTS, MOVES = 1 << 14, 4, 200
#: How full a filter may be before the next one begins.
LOAD = 0.9
#: Shards of the keys in a new index.
SHARDS = 64
#: Code points that a key must have.
LEAST = 10
#: Rows without an id are one document that comes after all others.
NO_ID = 2**63 - 1
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The digest of the line's key, None where the key has fewer code points than least."""
    key = line.strip(_SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


# -- one filter --


def places(keys: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Of each key a bucket and the fingerprint, which isn't 0."""
    x = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    print_ = (x[:, 1] >> np.uint64(48)).astype(np.uint16)
    return ((x[:, 0] >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64), np.where(print_ == 0, 1, print_).astype(np.uint16)


def other(bucket: np.ndarray, print_: np.ndarray, buckets: int) -> np.ndarray:
    """The other bucket of a fingerprint; that of the other is this one again."""
    return bucket ^ ((print_.astype(np.int64) * 0x5BD1E995 >> 7) & (buckets - 1))


def holds(table: np.ndarray, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
    """Which fingerprints lie in one of their buckets."""
    second = other(bucket, print_, len(table))
    return (table[bucket] == print_[:, None]).any(1) | (table[second] == print_[:, None]).any(1)


def put(table: np.ndarray, bucket: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts fingerprints in; returns (bucket, fingerprint) of those that found no place, others may have been moved for them."""
    for second in (False, True):
        at = other(bucket, print_, len(table)) if second else bucket
        order = np.argsort(at, kind="stable")
        at, bucket, print_ = at[order], bucket[order], print_[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        taken = table[at] != 0
        fits = rank < SLOTS - taken.sum(1)
        slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(at)), np.minimum(rank, SLOTS - 1)]
        table[at[fits], slot[fits]] = print_[fits]
        bucket, print_ = bucket[~fits], print_[~fits]
    homeless = []
    for b, p in zip(bucket.tolist(), print_.tolist(), strict=True):
        for move in range(MOVES):
            free = np.flatnonzero(table[b] == 0)
            if len(free):
                table[b, free[0]] = p
                break
            slot = (p + move) % SLOTS
            p, table[b, slot] = int(table[b, slot]), p
            b = int(other(np.int64(b), np.uint16(p), len(table)))
        else:
            homeless.append((b, p))
    left = np.array(homeless, np.int64).reshape(-1, 2)
    return left[:, 0], left[:, 1].astype(np.uint16)


def take(table: np.ndarray, bucket: int, print_: int) -> bool:
    """Takes one copy of a fingerprint out; False where there is none."""
    for b in (bucket, int(other(np.int64(bucket), np.uint16(print_), len(table)))):
        at = np.flatnonzero(table[b] == print_)
        if len(at):
            table[b, at[0]] = 0
            return True
    return False


class Chain:
    """The filters of a shard, all of one shape and with the same buckets for a key, so that it doesn't matter from which of them equal fingerprints are taken."""

    def __init__(self, data: bytes, buckets: int = BUCKETS):
        self.buckets = buckets
        flat = np.frombuffer(data, np.uint16).reshape(-1, buckets, SLOTS)
        self.tables = [t.copy() for t in flat]

    def holds(self, keys: list[bytes]) -> np.ndarray:
        if not self.tables:
            return np.zeros(len(keys), bool)
        bucket, print_ = places(keys, self.buckets)
        return functools.reduce(np.logical_or, (holds(t, bucket, print_) for t in self.tables), np.zeros(len(keys), bool))

    def insert(self, keys: list[bytes]) -> None:
        if not keys:
            return
        bucket, print_ = places(keys, self.buckets)
        at = max(0, len(self.tables) - 1)
        while len(bucket):
            if at == len(self.tables):
                self.tables.append(np.zeros((self.buckets, SLOTS), np.uint16))
            table = self.tables[at]
            room = max(0, int(LOAD * table.size) - np.count_nonzero(table))
            left = put(table, bucket[:room], print_[:room])
            bucket, print_ = np.concatenate([left[0], bucket[room:]]), np.concatenate([left[1], print_[room:]])
            at += 1

    def delete(self, keys: list[bytes]) -> None:
        if not keys:
            return
        bucket, print_ = places(keys, self.buckets)
        for b, p in zip(bucket.tolist(), print_.tolist(), strict=True):
            if not any(take(t, b, p) for t in reversed(self.tables)):
                raise ValueError("a key to delete is in no filter of its shard")
        self.tables = [t for i, t in enumerate(self.tables) if i == 0 or t.any()]

    def data(self) -> bytes:
        return b"".join(t.tobytes() for t in self.tables)


def _probed(buckets: int):
    """Those of a shard's keys that its filters may hold."""

    def run(keys: pa.Table, held: pa.Table) -> pa.Table:
        if not keys.num_rows:
            return keys
        seen = Chain(b"".join(held.column("filter").to_pylist()), buckets).holds(keys.column("key").to_pylist())
        return keys.filter(pa.array(seen))

    return run


def _changed(deletes: bool, buckets: int):
    """A shard's filters after its keys are put in or taken out."""

    def run(keys: pa.Table, held: pa.Table) -> pa.Table:
        shard = (keys if keys.num_rows else held).column("shard")[0].as_py()
        chain = Chain(b"".join(held.column("filter").to_pylist()), buckets)
        (chain.delete if deletes else chain.insert)(keys.column("key").to_pylist())
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([chain.data()], pa.binary())})

    return run


# -- keys of documents --


def _keys(least: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = set((text or "").encode("utf-8", "surrogatepass").split(b"\n"))
                keys = {k for k in (line_key(x, least) for x in lines) if k}
                row += [i] * len(keys)
                found += sorted(keys)
            at = pa.array(row, pa.int64())
            shard = np.array([int.from_bytes(k[:4], "little") % shards for k in found], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(found, pa.binary()), batch.column(0).take(at), batch.column(1).take(at)], names=["shard", "key", "doc", "th"])

    return run


def _without(least: int, names: list[str], text_at: int):
    """Takes the lines whose keys are in the last column out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, kept = [], [], []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                stay = lines
                if gone:
                    gone = set(gone)
                    stay = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass"), least) not in gone]
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept"])

    return run


def _counted(references: DataFrame) -> DataFrame:
    return references.groupBy("shard", "key").agg(F.countDistinct("doc").alias("refs"), F.min("doc").alias("owner"))


class LineIndex:
    """Lines and the documents that hold them, in a folder that the driver and all executors share.

    A folder is opened at its last whole generation: a change that fails leaves the one
    before. Rows of one id are one document, rows without id likewise (it comes after all
    others); a text that is null or empty is one empty line. An id that is inserted again
    adds its lines to those it has; to replace a document, delete it first.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shards: int = SHARDS, buckets: int = BUCKETS):
        self.spark, self.id_col, self.text_col = spark, id_col, text_col
        self.folder = folder or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.state = self._opened() or {"n": 0, "references": [], "counts": None, "filters": None, "least": least, "shards": shards, "buckets": buckets, "batches": []}

    # -- generations --

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _opened(self) -> dict | None:
        path, fs = self._path(self.folder)
        if not fs.exists(path):
            return None
        found = [x.getPath().getName() for x in fs.listStatus(path)]
        whole = [int(n[9:]) for n in found if n.startswith("manifest-") and fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")[0])]
        return json.loads(self.spark.read.text(f"{self.folder}/manifest-{max(whole)}").first()[0]) if whole else None

    def _publish(self, **new) -> None:
        """Writes the next generation's manifest, then deletes the tables that only the one before named."""
        old, state = self.state, self.state | new | {"n": self.state["n"] + 1}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest-{state['n']}")
        self.state = state
        named = lambda s: {*s["references"], s["counts"], s["filters"]} - {None}
        for path in [*(named(old) - named(state)), *([f"{self.folder}/manifest-{old['n']}"] if old["n"] else [])]:
            self._delete(path)

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def _write(self, df: DataFrame, what: str) -> str:
        path = f"{self.folder}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _table(self, path: str | None, shape: str) -> DataFrame:
        return self.spark.read.schema(shape).parquet(path) if path else self.spark.createDataFrame([], shape)

    def references(self) -> DataFrame:
        """shard, key, doc, th (hash of the text): what holds what."""
        shape = "shard int, key binary, doc long, th long"
        return self.spark.read.schema(shape).parquet(*self.state["references"]) if self.state["references"] else self._table(None, shape)

    def counts(self) -> DataFrame:
        """shard, key, refs, owner for each key that more than one document holds."""
        return self._table(self.state["counts"], "shard int, key binary, refs long, owner long")

    def filters(self) -> DataFrame:
        return self._table(self.state["filters"], "shard int, filter binary")

    def drop(self) -> None:
        """Deletes the folder."""
        self._delete(self.folder)

    # -- changes --

    def _told(self, docs: DataFrame) -> list:
        return [F.coalesce(docs[self.id_col].cast("long"), F.lit(NO_ID)).alias("__doc"), F.xxhash64(docs[self.text_col]).alias("__th")]

    def _beside_filters(self, keys: DataFrame):
        """The keys of each shard with its filters: the size of a group goes by the number of shards, as keys are digests."""
        return keys.select("shard", "key").groupBy("shard").cogroup(self.filters().groupBy("shard"))

    def _filtered(self, keys: DataFrame, deletes: bool) -> str:
        return self._write(self._beside_filters(keys).applyInArrow(_changed(deletes, self.state["buckets"]), "shard int, filter binary"), "filters")

    def insert(self, docs: DataFrame, batch: int | None = None) -> None:
        """Takes documents in. With a batch number, one that was taken in before is left out, so that a stream's batches may be repeated."""
        if batch is not None and batch in self.state["batches"]:
            return
        s = self.state
        rows = docs.select(*self._told(docs), docs[self.text_col].alias("__text"))
        added = self._write(rows.mapInArrow(_keys(s["least"], s["shards"]), "shard int, key binary, doc long, th long"), "references")
        new = self._table(added, "shard int, key binary, doc long, th long")
        made = self._write(_counted(new), "fresh")
        fresh = self._table(made, "shard int, key binary, refs long, owner long")
        over = [made]
        if not s["references"]:
            filters, counts = self._filtered(fresh, False), fresh.where("refs > 1")
        else:
            over.append(self._write(self._beside_filters(fresh).applyInArrow(_probed(s["buckets"]), "shard int, key binary"), "seen"))
            seen = self._table(over[-1], "shard int, key binary").select("key")
            over.append(self._write(self.references().join(seen, "key", "left_semi").select("shard", "key", "doc"), "before"))
            before = self._table(over[-1], "shard int, key binary, doc long")
            known = before.select("key").distinct()
            # a key that a filter only seemed to know goes in too: the filters hold each key once
            filters = self._filtered(fresh.join(known, "key", "left_anti"), False)
            again = _counted(before.unionByName(new.join(known, "key", "left_semi").select("shard", "key", "doc"))).where("refs > 1")
            first = fresh.where("refs > 1").join(known, "key", "left_anti")
            counts = self.counts().join(known, "key", "left_anti").unionByName(again).unionByName(first)
        counts = self._write(counts.select("shard", "key", "refs", "owner"), "counts")
        self._publish(references=[*s["references"], added], counts=counts, filters=filters, batches=[*s["batches"], *([] if batch is None else [batch])])
        for path in over:
            self._delete(path)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents of these ids (the column id_col) out; ids that aren't there count for nothing."""
        s = self.state
        gone = ids.select(F.coalesce(F.col(self.id_col).cast("long"), F.lit(NO_ID)).alias("doc")).distinct()
        held = {path: self._table(path, "shard int, key binary, doc long, th long") for path in s["references"]}
        held = {path: t for path, t in held.items() if not t.join(gone, "doc", "left_semi").isEmpty()}
        if not held:
            return
        lost = functools.reduce(DataFrame.unionByName, (t.join(gone, "doc", "left_semi").select("shard", "key") for t in held.values())).distinct()
        lost_at = self._write(lost, "lost")
        lost = self._table(lost_at, "shard int, key binary")
        kept = {path: self._write(t.join(gone, "doc", "left_anti").select("shard", "key", "doc", "th"), "references") for path, t in held.items()}
        references = [kept.get(path, path) for path in s["references"]]
        left = self.spark.read.schema("shard int, key binary, doc long, th long").parquet(*references)
        counted_at = self._write(_counted(left.join(lost.select("key"), "key", "left_semi")).select("shard", "key", "refs", "owner"), "fresh")
        counted = self._table(counted_at, "shard int, key binary, refs long, owner long")
        filters = self._filtered(lost.join(counted.select("key"), "key", "left_anti"), True)
        counts = self._write(self.counts().join(lost.select("key"), "key", "left_anti").unionByName(counted.where("refs > 1")), "counts")
        self._publish(references=references, counts=counts, filters=filters)
        for path in (lost_at, counted_at):
            self._delete(path)

    # -- results --

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """Rows of docs, which the index holds, with n_lines, n_dropped and kept (columns of these names give way): a line whose key more than one document holds stays in the one with the least id only.

        A row's dropped keys are found by its id and text, so rows of one id, or of none,
        don't meet in one group. The result reads the index's tables: keep them until it is
        written.
        """
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
        gone = self.references().join(self.counts().select("key", "owner"), "key").where("doc != owner")
        gone = gone.groupBy("doc", "th").agg(F.collect_set("key").alias("__gone"))
        rows = docs.withColumns(dict(zip(("__doc", "__th"), self._told(docs), strict=True)))
        rows = rows.join(gone, (rows["__doc"] == gone["doc"]) & (rows["__th"] == gone["th"]), "left")
        shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
        return rows.select(*(docs[c] for c in names), "__gone").mapInArrow(_without(self.state["least"], names, names.index(self.text_col)), ", ".join([*shape, "n_lines long, n_dropped long, kept string"]))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, shards: int = SHARDS, keep_text: bool = True) -> DataFrame:
    """All documents through an index of their own: id, n_lines, n_dropped, kept (its sha256 as kept_sha256 without keep_text), checkpointed. An empty table gives no rows."""
    index = LineIndex(docs.sparkSession, None, id_col, text_col, least, shards)
    try:
        docs = docs.select(id_col, text_col)
        index.insert(docs)
        out = index.deduplicated(docs)
        kept = F.col("kept") if keep_text else F.sha2("kept", 256).alias("kept_sha256")
        return checkpointed(out.select(id_col, "n_lines", "n_dropped", kept))
    finally:
        index.drop()
