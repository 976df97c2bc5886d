"""Tables and files (SNK1-SNK6, SNK10-SNK12, MET1, ERR1, ERR2)."""

from __future__ import annotations

import json
import logging
import re
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.session import new_shared_dir, remove

log = logging.getLogger("millrace")


class StepFailed(Exception):
    """A step of a job failed; carries the step's name."""

    def __init__(self, step: str, reason: str):
        super().__init__(f"{step}: {reason}")
        self.step = step


@contextmanager
def named_step(step: str):
    """Failures inside come out under the step's name and stop the run. Put it around sinks: that is
    where Spark evaluates."""
    try:
        yield
    except StepFailed:
        raise
    except Exception as error:
        log.error("%s failed: %s", step, error)
        raise StepFailed(step, str(error)) from error


def with_retries(action: Callable, retries: int = 0, interval: float = 1.0):
    """Call again up to `retries` times after a failure, `interval` seconds apart."""
    for attempt in range(retries + 1):
        try:
            return action()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(interval)


def guard_non_empty(df: DataFrame, step: str) -> DataFrame:
    """Fail before the write when there is nothing to write; looks for one row only."""
    if df.isEmpty():
        raise StepFailed(step, "no rows to write")
    return df


def insert_into(df: DataFrame, table: str) -> None:
    """Append to an existing table, by column name; never creates one."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        raise StepFailed(f"insert into {table}", "the table does not exist")
    df.select(*spark.table(table).columns).write.insertInto(table)


def append_table(df: DataFrame, table: str) -> None:
    """Append, creating the table when it is missing."""
    df.write.mode("append").saveAsTable(table)


def append_run(df: DataFrame, folder: str, run: str) -> None:
    """Add the rows of a run to a log that may be written again: a repeated run takes the place of its own rows.

    The rows go to a folder of this run, and a marker tells readers that it ended; until then, and after a run that
    failed, they see what was there before. `read_runs` reads the log.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/{RUNS}/{run}/{attempt}")
    marks = run_marks(spark, folder)
    marks.put(run, attempt)
    spark.catalog.refreshByPath(folder)


def read_runs(spark: SparkSession, folder: str, column: str = "run") -> DataFrame:
    """The rows of all runs that ended, with the run they belong to."""
    ended = run_marks(spark, folder).last()
    if not ended:
        raise StepFailed(f"read {folder}", "no run has ended")
    parts = [spark.read.parquet(f"{folder}/{RUNS}/{run}/{attempt}").withColumn(column, F.lit(run)) for run, attempt in sorted(ended.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


RUNS = "runs"


class run_marks:
    """Empty files that name a run, the order of its attempts and the attempt that holds its rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = self.path(folder, "_ended")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, run: str, attempt: str) -> None:
        self.files.create(self.path(self.folder, f"{run}.{time.time_ns()}.{attempt}")).close()

    def last(self) -> dict[str, str]:
        if not self.files.exists(self.folder):
            return {}
        names = sorted((f.getPath().getName().rsplit(".", 2) for f in self.files.listStatus(self.folder)), key=lambda n: int(n[1]))
        return {run: attempt for run, _, attempt in names}


def truncate_load(df: DataFrame, table: str, in_place: bool = False) -> None:
    """Replace the rows of an existing table.

    The rows are written once, to a new folder beside the table's; then the table moves there in one step of the
    catalog, and the old folder is deleted. A load that fails leaves the table as it was. What knows the folder and not
    the table has to ask the catalog for it; `in_place` keeps the folder, as tables with partitions always do: the
    rows are then computed into the shared folder first, since an overwrite empties the table before its tasks run.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        raise StepFailed(f"load {table}", "the table does not exist")
    rows = df.select(*[f"`{c.name}`" for c in spark.catalog.listColumns(table)])
    about = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON").first()[0])
    if not in_place and not about.get("partition_columns"):
        _move_to(rows, table, about)
        return
    folder = new_shared_dir(spark, "load")
    rows.write.parquet(folder)
    spark.read.schema(spark.table(table).schema).parquet(folder).write.insertInto(table, overwrite=True)
    remove(spark, folder)


def _move_to(rows: DataFrame, table: str, about: dict) -> None:
    """Write into a new table of the same definition in its own folder, then give that folder to the old name."""
    spark, load = rows.sparkSession, uuid.uuid4().hex
    path = spark._jvm.org.apache.hadoop.fs.Path
    old = path(about["location"])
    new = path(old.getParent(), f"{re.sub(r'-load-[0-9a-f]{32}$', '', old.getName())}-load-{load}")
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    place = new.toString().replace("\\", "\\\\").replace("'", "\\'")
    names = [*about.get("namespace", []), f"{about['table_name']}_load_{load}"]
    beside = ".".join(f"`{n}`" for n in names)
    spark.sql(f"CREATE TABLE {beside} LIKE {table} LOCATION '{place}'")
    try:
        rows.write.insertInto(beside)
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
    except Exception:
        files.delete(new, True)
        raise
    finally:
        # A table with a location of its own: its rows stay.
        drop_table(spark, beside)
    spark.catalog.refreshTable(table)
    files.delete(old, True)


def jdbc_load(df: DataFrame, url: str, table: str, properties: dict[str, str], truncate: bool = False) -> None:
    """The same into a database: append, or truncate and load."""
    writer = df.write.mode("overwrite" if truncate else "append").option("truncate", truncate)
    writer.jdbc(url, table, properties=properties)


#: Quotes inside a field are doubled, in what is written and what is read.
CSV_QUOTES = {"quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """Fields may hold quotes, and line breaks too: read those with `files.read_csv(multi_line=True)`."""
    df.write.mode(mode).options(header=header, **CSV_QUOTES).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def observed_write(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write and return the number of rows, counted on their way through: no second pass."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def write_error_report(df: DataFrame, folder: str, name: str = "error_reports") -> str:
    """CSV whose name tells the row count; when that write fails, once more under an `error_` name. The rows are
    computed once: into a table of the shared folder, whose write gives the count."""
    kept = new_shared_dir(df.sparkSession, "errors")
    rows = observed_write(df, lambda d: d.write.parquet(kept))
    df = df.sparkSession.read.schema(df.schema).parquet(kept)
    file_name = f"{name}_error_{rows}_rows.csv"
    path = f"{folder}/{file_name}"
    try:
        write_csv(df, path, mode="errorifexists")
        log.info("error report written: %s", path)
    except Exception as error:
        log.error("error report not written to %s: %s", path, error)
        path = f"{folder}/error_{file_name}"
        write_csv(df, path, mode="errorifexists")
        log.info("error report written: %s", path)
    remove(df.sparkSession, kept)
    return path


def csv_line(columns: Sequence[str], sep: str = ",", quote: str = '"') -> Column:
    """One delimited text per record; inner quotes are doubled, nulls are empty."""
    return F.to_csv(F.struct(*columns), {"sep": sep, "quote": quote, "escape": quote})


def csv_format(df: DataFrame, sep: str = ",", quote: str = '"', header: bool = False, column: str = "line") -> DataFrame:
    """Each record as one text. The header row, if asked for, has `is_header` true."""
    body = df.select(csv_line([f"`{c}`" for c in df.columns], sep, quote).alias(column))
    if not header:
        return body
    names = F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    line = F.to_csv(names, {"sep": sep, "quote": quote, "escape": quote})
    top = df.sparkSession.range(1).select(line.alias(column), F.lit(True).alias("is_header"))
    return top.union(body.withColumn("is_header", F.lit(False)))


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
