"""Files -> parsed rows -> staging table, with bad rows and the row count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.aggregates import row_count
from millrace.operators.routing import split_errors
from millrace.sinks.writers import named_step, observed_write, truncate_load, with_retries, write_csv
from millrace.sources.delimited import CORRUPT, STAGING_COLUMNS, parse_delimited, with_parsed_line


@dataclass(frozen=True)
class StagedRows:
    rows: DataFrame
    bad: DataFrame

    @property
    def count(self) -> DataFrame:
        """The second branch of the copy: one row, or none for an empty flow."""
        return row_count(self.rows)


def staged_from_files(spark: SparkSession, path: str, columns=STAGING_COLUMNS, **options) -> StagedRows:
    return StagedRows(*split_errors(parse_delimited(spark, path, columns, **options)))


def staged_from_lines(df: DataFrame, line: str, columns=STAGING_COLUMNS, **options) -> StagedRows:
    """Lines that are already rows of a frame."""
    parsed = with_parsed_line(df, line, columns, **options).select(*columns, CORRUPT)
    return StagedRows(*split_errors(parsed))


def load_staging(
    spark: SparkSession,
    path: str,
    table: str,
    bad_rows: str | None = None,
    retries: int = 0,
    interval: float = 1.0,
    **options,
) -> int:
    """Replace the staging table by the good rows of the files and return their number.

    The count comes from the write itself. The table is emptied when the new rows are ready, so a
    file that cannot be read leaves the old rows in place.
    """
    staged = staged_from_files(spark, path, **options)
    with named_step("load staging"):
        rows = with_retries(
            lambda: observed_write(staged.rows, lambda df: truncate_load(df, table)), retries, interval
        )
    if bad_rows is not None:
        with named_step("write bad rows"):
            write_csv(staged.bad, bad_rows)
    return rows
