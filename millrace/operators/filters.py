"""Filters (FLT1-FLT5)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def where_in(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """For a short literal list; against a table of ids use `joins.semi_join`."""
    return df.filter(F.col(column).isin(list(allowed)))


def where_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def where_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def where_any(df: DataFrame, columns: Sequence[str], predicate: Callable[[Column], Column]) -> DataFrame:
    """Rows where the predicate holds for at least one of the columns."""
    return df.filter(reduce(Column.__or__, [predicate(F.col(c)) for c in columns]))
