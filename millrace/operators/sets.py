"""Unions (SET1-SET3; SET3 is `aggregates.distinct_rows`)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union(*frames: DataFrame) -> DataFrame:
    """All documents of all inputs, by field name; a field that an input lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_positional(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, frames)
