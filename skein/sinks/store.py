"""Content-addressed tables and checkpoints of runs, and published generations of an index."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stable_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: Any) -> str:
    return hashlib.sha256(stable_json(value).encode()).hexdigest()


def table_digest(df: DataFrame) -> str:
    """Of the rows, whatever their order: counts and sums of their hashes, so nothing is collected."""
    rows = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    parts = [F.sum(F.conv(F.substring(F.sha2(rows, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    found = df.agg(F.count("*"), *parts).first()
    return digest([str(x) for x in found])


class Store:
    """Objects under root/objects by digest, manifests under root/checkpoints; any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def put_table(self, df: DataFrame) -> str:
        ref = f"table:{table_digest(df)}"
        path = f"{self.root}/objects/{ref.replace(':', '-')}"
        if not self._exists(f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return ref

    def get_table(self, ref: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/objects/{ref.replace(':', '-')}")

    def _write(self, path: str, body: str) -> None:
        out = self._fs.create(self._path(f"{path}.part"), True)
        out.write(bytearray(body.encode()))
        out.close()
        # replaces what is there in one step, so that a reader finds the old or the new one
        jvm = self.spark._jvm
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        target = self._path(path)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(self._path(f"{path}.part")), self._fs.makeQualified(target), how)

    def checkpoint(self, created_at: str, refs: dict[str, str], transforms: list[dict], parent: str | None = None) -> str:
        """Writes a manifest; its id is its time and the first digits of its digest."""
        body = {"createdAt": created_at, "refs": refs, "transforms": transforms, "parentId": parent if parent is not None else self.latest()}
        name = f"{created_at.replace(':', '-')}-{digest(body)[:8]}"
        self._write(f"{self.root}/checkpoints/{name}.json", stable_json({"id": name, **body}))
        return name

    def checkpoints(self) -> list[dict]:
        """Manifests by time; unreadable ones are passed over."""
        if not self._exists(f"{self.root}/checkpoints"):
            return []
        found = []
        for r in self.spark.read.option("pathGlobFilter", "*.json").text(f"{self.root}/checkpoints", wholetext=True).collect():
            try:
                found.append(json.loads(r["value"]))
            except ValueError:
                continue
        return sorted(found, key=lambda m: (m["createdAt"], m["id"]))

    def latest(self) -> str | None:
        found = self.checkpoints()
        return found[-1]["id"] if found else None

    def publish(self, index: DataFrame, manifest: dict) -> str:
        """A new generation of an index, then the pointer to it."""
        name = f"gen-{digest(manifest)}"
        path = f"{self.root}/{name}"
        if not self._exists(f"{path}/_SUCCESS"):
            index.write.mode("overwrite").parquet(path)
        self._write(f"{self.root}/CURRENT", name)
        return name

    def current(self) -> DataFrame:
        name = self.spark.read.text(f"{self.root}/CURRENT").first()["value"]
        return self.spark.read.parquet(f"{self.root}/{name}")
