"""Conditional values, defaults and settings (FLT6, SC7, SC10, SC19, SC20)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def case_chain(branches: Sequence[tuple[Column, Column | str | int | bool]], otherwise=None) -> Column:
    """Value of the first branch whose condition holds."""
    (condition, value), *rest = branches
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def value_or(default, *candidates: Column, empty_is_missing: bool = False) -> Column:
    """First candidate that is present; `empty_is_missing` passes over empty texts too."""
    if empty_is_missing:
        candidates = tuple(F.nullif(c, F.lit("")) for c in candidates)
    return F.coalesce(*candidates, F.lit(default))


def config_value(config: Column, environment: Column | str, default=None) -> Column:
    """Entry of an environment map; an environment that is not listed takes the default."""
    found = F.try_element_at(config, environment if isinstance(environment, Column) else F.lit(environment))
    return F.coalesce(found, F.lit(default))


def in_list(value: Column, allowed: Sequence) -> Column:
    """Membership as a plain true or false; a null value is not a member."""
    return F.when(value.isin(list(allowed)), F.lit(True)).otherwise(F.lit(False))
