"""Table updates as rewrites (UPD1, UPD2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def mark_matched(df: DataFrame, keys: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """All rows, with a column that tells whether the key is in `keys`."""
    marks = keys.select(*on).dropDuplicates().withColumn(column, F.lit(True))
    return df.join(marks, list(on), "left").select(*df.columns, F.coalesce(column, F.lit(False)).alias(column))


def update_matched(df: DataFrame, keys: DataFrame, on: Sequence[str], changes: dict[str, Column]) -> DataFrame:
    """The table with new values in the rows whose key is in `keys`; all other rows stay as they are."""
    marked = mark_matched(df, keys, on, "_hit")
    changed = {c: F.when(F.col("_hit"), value).otherwise(F.col(c)) for c, value in changes.items() if c in df.columns}
    added = {c: F.when(F.col("_hit"), value) for c, value in changes.items() if c not in df.columns}
    return marked.withColumns({**changed, **added}).select(*df.columns, *added)


def with_destination(queue: DataFrame, done: DataFrame, on: Sequence[str], column: str = "destination") -> DataFrame:
    """All rows of the queue in one pass, with `log` or `queue` as the place where each belongs now."""
    marked = mark_matched(queue, done, on, "_done")
    return marked.select(*queue.columns, F.when(F.col("_done"), "log").otherwise("queue").alias(column))


def move_matched(queue: DataFrame, done: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows for the log, remaining queue): the log is to be appended, the queue replaced. Both come from one
    join, whose rows are written once to the shared folder."""
    sent = cut_lineage(with_destination(queue, done, on, "_destination"), "moved")
    log, rest = (sent.filter(F.col("_destination") == d).select(*queue.columns) for d in ("log", "queue"))
    return log, rest
