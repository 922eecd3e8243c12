"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir, which all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder in use. Where neither the context nor the session names one, a local master gets a temporary folder and any other an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="skein-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


class Tables:
    """Intermediate tables, written as Parquet in the shared checkpoint folder and dropped when they are done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, table: DataFrame | None = None) -> None:
        """Deletes one table, or all of them."""
        jvm = self.spark._jvm
        for path in [p for p, t in self.paths.items() if table is None or t is table]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            del self.paths[path]


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done with: it does so when the driver collects its garbage."""
    for _ in range(2):  # the first round ends the plans' objects on either side, the second what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc32(column: str) -> Column:
    """crc32 of an integer id written as text; folds and samples go by it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
