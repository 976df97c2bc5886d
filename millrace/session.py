"""Session settings, the shared working folder, and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Longer ordered limits sort the frame: the rows of a top-k stay in the memory of each task.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def build_session(app: str = "millrace", master: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's settings; on a cluster, `spark-submit` gives the master."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path below the folder that all executors see (`spark.checkpoint.dir`, or the session's checkpoint
    folder). A temporary folder is made only where driver and executors are one process; a cluster
    without a shared folder is an error, since its machines would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if base is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts])


def new_shared_dir(spark: SparkSession, purpose: str) -> str:
    """A path that no other run uses."""
    return shared_dir(spark, "millrace", f"{purpose}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one when nothing needs it any more."""
    if not folder.startswith(shared_dir(spark, "millrace")):
        raise ValueError(f"{folder} is not a working folder")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """The rows as a table in the shared folder: they survive the loss of the executors that made
    them, and the plans built on them know their size."""
    folder = new_shared_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Rounds:
    """Tables of a loop. Each is written when the one before is still there, and older ones are deleted."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose, self.folders = spark, purpose, []

    def keep(self, df: DataFrame) -> DataFrame:
        folder = new_shared_dir(self.spark, self.purpose)
        df.write.parquet(folder)
        self.folders.append(folder)
        if len(self.folders) > 2:
            remove(self.spark, self.folders.pop(0))
        return self.spark.read.schema(df.schema).parquet(folder)
