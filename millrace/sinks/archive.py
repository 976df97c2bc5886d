"""Month archive (SNK7)."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import month_stamp
from millrace.functions.text import joined

MONTH = "yyyymm"
RUN = "_archived_run"
NAME = "_archived_name"
VERSION = "_archived_version"


def archive_path(folder: Column | str, name: Column, at: Column | None = None) -> Column:
    """Directory + month + `/` + file name."""
    return joined(folder, month_stamp(at), "/", name)


def archive_write(
    df: DataFrame, folder: str, name: str, modified: Sequence[str], at: Column | None = None, stamp: Column | None = None
) -> None:
    """Add files (or any named records) under their month; those of the same name take the place of earlier ones.

    A run only appends a folder of its own below each month, and then a marker by which readers know
    that it ended: no month is read or rewritten, and what a failed run left is never seen. A repeated
    run shows the same archive. `read_archive` leaves out what was replaced, `compact_archive` drops it.
    """
    _append(df.select("*", (month_stamp(at) if stamp is None else stamp).alias(MONTH)), folder, name, modified)


def _append(df: DataFrame, folder: str, name: str, modified: Sequence[str]) -> None:
    spark, run = df.sparkSession, time.time_ns()
    version = F.struct(*[F.col(f"`{m}`") for m in modified], F.monotonically_increasing_id().alias("_row"))
    rows = df.select("*", F.lit(run).alias(RUN), F.col(f"`{name}`").alias(NAME), version.alias(VERSION))
    # Large months are split into files of even size.
    rows.hint("rebalance", MONTH).write.mode("append").partitionBy(MONTH, RUN).parquet(folder)
    _runs(spark, folder).touch(run)
    spark.catalog.refreshByPath(folder)


def read_archive(spark: SparkSession, folder: str, replaced: bool = False) -> DataFrame:
    """The archive, one row per month and name; a filter on `yyyymm` reads only those months.

    The last version of a name is the one with the last stamps, and of equal ones that of the last run: an older file
    that is archived later replaces nothing. It is found on month, name, run and stamps alone. What it replaced is then
    left out by a join with its numbers, which is small where little is replaced.
    """
    stored = spark.read.parquet(folder)
    stored = stored.withColumn(MONTH, F.col(MONTH).cast("string")).filter(F.col(RUN).isin(_runs(spark, folder).ended()))
    stamps = [F.col(f"{VERSION}.`{c}`") for c in stored.schema[VERSION].dataType.names]
    # the last field of a version only tells rows of one run apart
    narrow = stored.select(MONTH, NAME, RUN, VERSION, F.struct(*stamps[:-1], RUN, stamps[-1]).alias("_age"))
    latest = narrow.groupBy(MONTH, NAME).agg(F.max("_age").alias("_last"), F.count(F.lit(1)).alias("_n"))
    several = latest.filter("_n > 1").select(F.col(MONTH).alias("_m"), F.col(NAME).alias("_f"), "_last")
    same = (F.col(MONTH) == F.col("_m")) & F.col(NAME).eqNullSafe(F.col("_f"))
    older = narrow.join(several, same).filter(F.col("_age") < F.col("_last"))
    older = older.select(F.col(MONTH).alias("_m"), F.col(RUN).alias("_r"), F.col(f"{VERSION}._row").alias("_row"))
    gone = (F.col(MONTH) == F.col("_m")) & (F.col(RUN) == F.col("_r")) & (F.col(f"{VERSION}._row") == F.col("_row"))
    kept = stored if replaced else stored.join(older, gone, "left_anti")
    return kept.drop(RUN, NAME, VERSION)


def compact_archive(spark: SparkSession, folder: str, into: str, name: str, modified: Sequence[str]) -> None:
    """The archive without what was replaced, as one run in a new folder. The old one stays as it is."""
    _append(read_archive(spark, folder), into, name, modified)


class _runs:
    """Markers of the runs that ended: empty files beside the months, which scans pass over."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = self.path(folder, "_runs")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def touch(self, run: int) -> None:
        self.files.create(self.path(self.folder, str(run))).close()

    def ended(self) -> list[int]:
        if not self.files.exists(self.folder):
            return []
        return [int(f.getPath().getName()) for f in self.files.listStatus(self.folder)]
