"""A published search index: rows and positional trigram postings in pieces, one for each build that added files."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import log, search
from skein.operators.segments import extracted, segments
from skein.operators.tables import checkpointed
from skein.sinks.store import Store, digest
from skein.sources.exports import below, file_digests
from skein.sources.lines import numbered_lines

#: What a manifest has to say, for this code to read its pieces.
SCHEMA, TOKENIZER = "skein-search-1", "trigram case_sensitive positions"
BUCKETS = 64
#: Tasks that share a bucket's rows.
SLICES = 16
ROW = "fid long, n long, file string, source string, line long, event_id string, segment int, platform string, session string, role string, kind string, at string, text string"
POSTING = "bucket int, trigram string, fid long, n long, positions array<int>"
FILES = "file string, sha256 string, bytes long, fid long, seen long, searchable long, other long, errors long, piece string"
IDS = "id string, body_digest string, fid long"


class Busy(RuntimeError):
    """Another build holds the lock."""


class SearchIndex:
    """Files of events under a folder, searched by literal text.

    root/CURRENT names a generation, a manifest of files (by path and digest) and pieces.
    A build takes the lock (a file that only one can create), digests the files, extracts
    those whose digest no piece has, writes them as a new piece, and swaps the pointer
    last: a reader sees the old generation or the new one, and a failed build leaves the
    old one. What it left behind goes at the start of the next.
    """

    def __init__(self, spark: SparkSession, root: str, suffix: str = ".lync", stale_after: float | None = None):
        self.spark, self.root, self.suffix, self.stale_after = spark, root.rstrip("/"), suffix, stale_after
        self.store = Store(spark, root)
        self._path, self._fs = self.store._path, self.store._fs

    # -- lock and generations --

    def _acquire(self) -> str:
        name, lock = uuid.uuid4().hex, self._path(f"{self.root}/lock")
        if self.stale_after is not None and self._fs.exists(lock) and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > self.stale_after:
            self._fs.delete(lock, False)
        try:
            out = self._fs.create(lock, False)
        except Exception as e:
            if self._fs.exists(lock):
                raise Busy(f"{self.root}: another build holds the lock") from e
            raise
        out.write(bytearray(name.encode()))
        out.close()
        return name

    def _clean(self, kept: set[str]) -> None:
        """Stages of builds that failed, and pieces that no generation in use names."""
        for x in self._fs.listStatus(self._path(self.root)):
            name = x.getPath().getName()
            if name.startswith("stage-") or name.startswith("piece-") and name not in kept:
                self._fs.delete(x.getPath(), True)

    def manifest(self) -> dict | None:
        """That of the current generation; raises where it isn't of this schema and tokenizer."""
        if not self._fs.exists(self._path(f"{self.root}/CURRENT")):
            return None
        name = self.spark.read.text(f"{self.root}/CURRENT").first()["value"]
        if not name.startswith("gen-"):
            raise ValueError(f"{self.root}/CURRENT names no generation")
        found = json.loads(self.spark.read.text(f"{self.root}/{name}/manifest.json", wholetext=True).first()["value"])
        if (found.get("schema"), found.get("tokenizer")) != (SCHEMA, TOKENIZER):
            raise ValueError(f"{self.root}: an index of another schema or tokenizer")
        return found | {"name": name}

    def _files(self, manifest: dict | None) -> DataFrame:
        if manifest is None:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.root}/{manifest['name']}/files")

    def _pieces(self, manifest: dict, what: str, shape: str) -> DataFrame:
        if not manifest["pieces"]:
            return self.spark.createDataFrame([], shape)
        # by their folders, so that only a piece's own are listed; buckets are folders below
        found = [self.spark.read.schema(shape).parquet(f"{self.root}/{p}/{what}") for p in manifest["pieces"]]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out

    # -- building --

    def build(self, folder: str, whole: bool = False) -> dict:
        """Brings the index to the files of folder that end in suffix: their manifest, with files taken in (added) and kept.

        With whole, or where more than eight pieces would be live, all files go into one
        new piece. Raises, with nothing published, if a line is no accepted event, a
        message has an error, one id has several bodies, a file changes meanwhile, or the
        counts of a file don't add up.
        """
        if not self._fs.exists(self._path(self.root)):
            self._fs.mkdirs(self._path(self.root))
        self._acquire()
        try:
            return self._build(folder, whole)
        finally:
            self._fs.delete(self._path(f"{self.root}/lock"), False)

    def _build(self, folder: str, whole: bool) -> dict:
        before = self.manifest()
        self._clean(set(before["pieces"]) if before else set())
        fid = F.xxhash64("path", "sha256")
        now = checkpointed(file_digests(self.spark, folder, self.suffix).withColumn("fid", fid).withColumnRenamed("path", "file"))
        whole = whole or bool(before) and len(before["pieces"]) > 7
        known = self._files(None if whole else before)
        fresh = checkpointed(now.join(known.select("fid"), "fid", "left_anti"))
        kept = known.join(now.select("fid"), "fid", "left_semi").select(*self._files(None).columns)
        stage, piece, added = f"{self.root}/stage-{uuid.uuid4().hex}", None, fresh.count()
        files = kept
        if added:
            lines = numbered_lines(self.spark, folder, f"*{self.suffix}").where("text != ''")
            lines = lines.withColumn("path", below("file", folder)).join(fresh.select(F.col("file").alias("path"), "fid"), "path").select(F.col("path").alias("file"), "line", "text")
            rows = checkpointed(log.classified(lines))
            self._refuse(rows.where("class not in ('accepted', 'conflict-variant')"), lambda r: f"{r['file']}:{r['line']} is {r['class']}")
            found = checkpointed(extracted(rows.withColumn("class", F.lit("accepted"))))
            self._refuse(found.where("status = 'error'"), lambda r: f"{r['file']}:{r['line']}: {r['reason']}")
            per = found.groupBy("file").agg(F.count("*").alias("seen"), *(F.count(F.when(F.col("status") == s, 1)).alias(c) for s, c in (("searchable", "searchable"), ("other", "other"), ("error", "errors"))))
            per = rows.groupBy("file").agg(F.count("*").alias("all")).join(per, "file", "left").fillna(0, ["seen", "searchable", "other", "errors"])
            log.reconcile(per, "all", ("searchable", "other", "errors"))
            name = fresh.select("file", "fid")
            said = segments(found).join(name, "file").withColumn("n", F.xxhash64("source", "line", "event_id", "segment"))
            said.select(*[f.split()[0] for f in ROW.split(", ")]).write.parquet(f"{stage}/rows")
            write_postings(self.spark.read.parquet(f"{stage}/rows"), f"{stage}/postings")
            rows.select("id", "body_digest", "file").join(name, "file").select("id", "body_digest", "fid").distinct().write.parquet(f"{stage}/ids")
            ids = self.spark.read.schema(IDS).parquet(f"{stage}/ids")
            if before and not whole:
                ids = ids.unionByName(self._pieces(before, "ids", IDS).join(kept.select("fid"), "fid", "left_semi"))
            self._refuse(ids.groupBy("id").agg(F.countDistinct("body_digest").alias("n")).where("n > 1"), lambda r: f"{r['id']} has {r['n']} bodies")
            again = file_digests(self.spark, folder, self.suffix).select(F.col("path").alias("file"), F.col("sha256").alias("now"))
            self._refuse(fresh.join(again, "file", "left").where("not (sha256 <=> now)"), lambda r: f"{r['file']} changed while it was read")
            piece = f"piece-{uuid.uuid4().hex}"
            self._fs.rename(self._path(stage), self._path(f"{self.root}/{piece}"))
            new = fresh.join(per, "file", "left").fillna(0, ["seen", "searchable", "other", "errors"]).withColumn("piece", F.lit(piece))
            files = files.unionByName(new.select(*files.columns))
        files = checkpointed(files)
        pieces = sorted(r[0] for r in files.select("piece").distinct().collect())
        totals = files.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("seen", "searchable", "other"))).first()
        body = {"schema": SCHEMA, "tokenizer": TOKENIZER, "pieces": pieces, "files": totals[0], "seen": totals[1], "searchable": totals[2], "other": totals[3]}
        name = f"gen-{digest(body)}"
        if before and before["name"] == name:
            return body | {"name": name, "added": 0, "kept": totals[0]}
        files.write.mode("overwrite").parquet(f"{self.root}/{name}/files")
        self.store._write(f"{self.root}/{name}/manifest.json", json.dumps(body, sort_keys=True))
        self.store._write(f"{self.root}/CURRENT", name)
        return body | {"name": name, "added": added, "kept": totals[0] - added}

    @staticmethod
    def _refuse(bad: DataFrame, say) -> None:
        found = bad.limit(1).collect()
        if found:
            raise ValueError(say(found[0]))

    # -- searching --

    def candidates(self, query: str, manifest: dict) -> DataFrame:
        """fid, n of rows that hold the query, of files that are still there."""
        return phrase_hits(self._pieces(manifest, "postings", POSTING), query).join(self._files(manifest).select("fid"), "fid", "left_semi")

    def find(self, query: str, limit: int = search.DEFAULT) -> DataFrame:
        """Rows whose text holds the query, case-sensitive, by source, line, event and segment."""
        search._checked(query, limit)
        manifest = self.manifest()
        if manifest is None:
            raise ValueError(f"{self.root} holds no index")
        rows = self._pieces(manifest, "rows", ROW).join(self.candidates(query, manifest), ["fid", "n"], "left_semi")
        shown = rows.dropDuplicates(["source", "line", "event_id", "segment"]).drop("fid", "n", "file")
        return shown.where(F.contains("text", F.lit(query))).orderBy("source", "line", "event_id", "segment").limit(limit)


def bucket() -> Column:
    return F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int").alias("bucket")


def write_postings(rows: DataFrame, path: str) -> None:
    """Every trigram of every row (fid, n, text) with the places where it begins (from 1, in code points), in a folder for each bucket, sorted by trigram; a frequent trigram is spread over tasks by its rows. Texts move before they are taken apart, postings once after."""
    size = F.length("text")
    grams = F.when(size >= 3, F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.struct(F.substr("text", i, F.lit(3)).alias("trigram"), i.cast("int").alias("at"))))
    # a row's trigrams meet where the row is
    each = rows.repartition("fid", "n").select("fid", "n", F.inline(grams)).groupBy("fid", "n", "trigram").agg(F.array_sort(F.collect_list("at")).alias("positions"))
    # dealt by hashes: ranges would gather all positions twice, the first time for their bounds
    each = each.withColumn("bucket", bucket()).repartition("bucket", F.pmod(F.xxhash64("fid", "n"), F.lit(SLICES)))
    each = each.sortWithinPartitions("bucket", "trigram", "fid", "n")
    each.write.partitionBy("bucket").parquet(path)


def phrase_hits(postings: DataFrame, query: str) -> DataFrame:
    """fid, n of rows that hold the query: its trigrams begin in them one behind the other. Read are the folders of the trigrams' buckets, and of these the row groups of the trigrams."""
    grams = [query[i : i + 3] for i in range(len(query) - 2)]
    wanted = postings.sparkSession.createDataFrame([(g, i) for i, g in enumerate(grams)], "trigram string, offset int")
    buckets = sorted({r[0] for r in wanted.select(bucket()).collect()})
    posts = postings.where(F.col("bucket").isin(buckets) & F.col("trigram").isin(sorted(set(grams))))
    # as many rows as the query has trigrams
    starts = posts.join(F.broadcast(wanted), "trigram").select("fid", "n", "offset", F.explode("positions").alias("p")).withColumn("start", F.col("p") - F.col("offset"))
    hits = starts.groupBy("fid", "n", "start").agg(F.countDistinct("offset").alias("k")).where(F.col("k") == len(grams))
    return hits.select("fid", "n").distinct()
