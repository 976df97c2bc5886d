"""Aggregations (AGG1-AGG8, LIM3). All combine within tasks before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.jsontext import is_json_object


def conditional_count(df: DataFrame, keys: Sequence[str], column: str, values: Mapping[str, str]) -> DataFrame:
    """Per key, the number of rows of each value: `values` gives result name -> value; none is 0."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(name) for name, v in values.items()])


def row_count(df: DataFrame, name: str = "rowCount") -> DataFrame:
    """The last running count of a flow: one row, or none for an empty flow."""
    return df.agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 0)


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_column(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Number of rows where the column is present."""
    return df.groupBy(*keys).agg(F.count(F.col(column)).alias(name))


def count_nulls(df: DataFrame, column: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(F.col(column).isNull()).alias(name))


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()


def first_value(df: DataFrame, column: str, order: Sequence[str], name: str) -> DataFrame:
    """The field of the first row in the given order, as one row."""
    return df.agg(F.min_by(F.col(column), F.struct(*order)).alias(name))


def top_level_key_profile(files: DataFrame, text: str = "text") -> DataFrame:
    """In how many JSON objects each top-level key occurs."""
    names = F.explode(F.array_distinct(F.json_object_keys(F.col(text)))).alias("key")
    return files.filter(is_json_object(F.col(text))).select(names).groupBy("key").agg(F.count(F.lit(1)).alias("n_files"))


def assemble(
    df: DataFrame, keys: Sequence[str], position: str, text: str, glue: str = "\n", rows_per_part: int = 4096
) -> DataFrame:
    """The texts of each document, joined in order of position.

    Runs of `rows_per_part` positions are joined first, so the lines of one long document are
    gathered by many tasks and only its few parts meet in the end.
    """
    part = F.floor(F.col(position) / rows_per_part).alias("_part")
    parts = df.select(*keys, part, position, text).groupBy(*keys, "_part").agg(_in_order(position, text, glue))
    return parts.groupBy(*keys).agg(_in_order("_part", text, glue))


def _in_order(position: str, text: str, glue: str):
    pieces = F.array_sort(F.collect_list(F.struct(position, text)))
    return F.array_join(F.transform(pieces, lambda p: p[text]), glue).alias(text)
