"""A tree of files converted to a tree of event files: one output for each input, at the mirrored place."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import log, sessions
from skein.operators.tables import checkpointed
from skein.sinks.files import event_lines
from skein.sources.exports import below
from skein.sources.lines import numbered_lines

#: Permissions of private files and folders.
FILE_MODE, FOLDER_MODE = "600", "700"


class _Files:
    """The file system of a path, through Hadoop."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def private(self, path, mode: str) -> None:
        self.fs.setPermission(path, self.jvm.org.apache.hadoop.fs.permission.FsPermission(mode))

    def folders(self, root: str, below_: list[str]) -> str:
        """The folder root/below, made where it is missing, private from root on."""
        at = root
        for part in ["", *below_]:
            at = f"{at}/{part}" if part else at
            if not self.fs.exists(self.path(at)):
                self.fs.mkdirs(self.path(at))
                self.private(self.path(at), FOLDER_MODE)
        return at

    def unreadable(self, root: str, suffix: str) -> dict[str, str]:
        """Files below root that end in suffix and can't be opened, with the reason."""
        bad, found = {}, self.fs.listFiles(self.path(root), True)
        while found.hasNext():
            at = found.next().getPath()
            if at.getName().endswith(suffix):
                try:
                    self.fs.open(at).close()
                except Exception as e:
                    bad[at.toString()] = str(getattr(e, "java_exception", e)).splitlines()[0]
        return bad

    def replace(self, parts: list, target: str) -> None:
        """Puts the parts, one after the other, in the place of target in one step, private."""
        end = self.path(target)
        begun = self.path(f"{end.getParent().toString()}/.{end.getName()}.{uuid.uuid4().hex}")
        if len(parts) == 1:
            self.fs.rename(parts[0], begun)
        else:
            out = self.fs.create(begun, False)
            try:
                for p in parts:
                    part = self.fs.open(p)
                    try:
                        self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, self.conf, False)
                    finally:
                        part.close()
            finally:
                out.close()
        self.private(begun, FILE_MODE)
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        how = self.gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        context.rename(self.fs.makeQualified(begun), self.fs.makeQualified(end), how)


def write_tree(lines: DataFrame, root: str, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """file, lines of the files written: each file's values (file, order columns, value) as root/file.

    lines: file, line, sub, value. Spark writes parts in a stage below root, sorted, a long
    file over several tasks; check gets the staged lines (file, line, text) and may
    raise. Only then each file replaces the one before it, in one step. Where anything
    fails before, the stage goes and every earlier output is as it was.
    """
    spark = lines.sparkSession
    files = _Files(spark, root)
    files.folders(root, [])
    stage = f"{root}/.stage-{uuid.uuid4().hex}"
    try:
        order = ("file", "line", "sub")
        lines.repartitionByRange(*order).sortWithinPartitions(*order).select("file", "value").write.partitionBy("file").option("lineSep", "\n").text(stage)
        # a file's name is escaped in its folder's, and that in the address
        plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
        staged = numbered_lines(spark, stage).withColumn("file", plain(F.regexp_extract(plain(F.col("file")), "file=([^/]*)/", 1)))
        if check is not None:
            check(staged)
        report = checkpointed(staged.groupBy("file").agg(F.count("*").alias("lines")))
        made = [x.getPath() for x in files.fs.listStatus(files.path(stage)) if x.isDirectory()]
        for folder in made:
            name = unquote(folder.getName().removeprefix("file="))
            parts = sorted((x.getPath() for x in files.fs.listStatus(folder) if x.getPath().getName().startswith("part-")), key=lambda p: p.getName())
            *above, last = name.split("/")
            files.replace(parts, f"{files.folders(root, above)}/{last}")
        return report
    finally:
        files.fs.delete(files.path(stage), True)


def session_lines(events: DataFrame) -> DataFrame:
    """file, line, sub, value: lines of session events (operators.sessions), with where they come from in the payload."""
    kept = events.where("skip is null")
    place = F.struct(F.col("file").alias("path"), F.col("line").cast("long").alias("line"), *([F.col("session").alias("sessionId")] if "session" in kept.columns else []))
    own = F.parse_json("message").alias("message") if "message" in kept.columns else F.parse_json("body").alias("payload")
    payload = F.to_json(F.struct(own, place.alias("source")))
    rows = kept.withColumns({"payload": payload, "actor": F.substring_index("kind", "/", 1), "critical": F.lit(False), "sub": F.col("sub") if "sub" in kept.columns else F.lit(0)})
    return event_lines(rows, carried=("file", "line", "sub")).select("file", "line", "sub", "value")


def convert_tree(spark: SparkSession, source: str, root: str, mapper: Callable[[DataFrame], DataFrame], suffix: str = ".jsonl", new_suffix: str = ".lync") -> dict:
    """Converts every file below source that ends in suffix; returns files, converted, unreadable (path and reason), lines, emitted, skipped, blank.

    mapper: sessions.claude_events or sessions.codex_events. Two files of one logical name
    are refused before anything is written. What can't be opened is named and left out,
    and its earlier output stays. Every line is read back and has to be accepted, and a
    file's lines have to be what was emitted.
    """
    if root.rstrip("/").startswith(source.rstrip("/") + "/") or source.rstrip("/").startswith(root.rstrip("/") + "/") or source.rstrip("/") == root.rstrip("/"):
        raise ValueError("source and output overlap")
    files = _Files(spark, source)
    bad = files.unreadable(source, suffix)
    found, listed = files.fs.listFiles(files.path(source), True), []
    while found.hasNext():
        x = found.next()
        if x.getPath().getName().endswith(suffix) and x.getPath().toString() not in bad:
            listed.append(x.getPath().toString())
    total = {"files": len(listed) + len(bad), "converted": len(listed), "unreadable": bad, "lines": 0, "emitted": 0, "skipped": 0, "blank": 0}
    if not listed:
        return total
    clash = sessions.collisions(spark.createDataFrame([(p,) for p in listed], "path string").select(below("path", source).alias("file"))).limit(1).collect()
    if clash:
        raise ValueError(f"files of one logical name: {clash[0]['files']}")
    # the files by name only where some have to be left out
    read = numbered_lines(spark, listed) if bad else numbered_lines(spark, source, f"*{suffix}")
    lines = read.withColumn("file", sessions.locator(below("file", source)))
    events = checkpointed(mapper(lines))
    report = checkpointed(sessions.file_report(events))
    values = session_lines(events).withColumn("file", F.regexp_replace("file", suffix.replace(".", "[.]") + "$", new_suffix))

    def check(staged: DataFrame) -> None:
        log.verified(log.classified(staged))
        # an event more for each session that a head names is emitted too
        wanted = values.groupBy("file").agg(F.count("*").alias("n"))
        off = wanted.join(staged.groupBy("file").agg(F.count("*").alias("m")), "file", "full_outer").where("not (n <=> m)").limit(1).collect()
        if off:
            raise ValueError(f"{off[0]['file']}: {off[0]['n']} lines were to be written, {off[0]['m']} were")

    write_tree(values, root, check)
    sums = report.agg(*(F.sum(c) for c in ("emitted", "skipped", "blank"))).first()
    return total | {"emitted": sums[0], "skipped": sums[1], "blank": sums[2], "lines": read.count()}
