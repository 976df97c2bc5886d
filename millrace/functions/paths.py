"""File names and paths (SC17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that stripped copies and working copies of a file carry in their names.
STRIPPED_SUFFIX = "_sanitized"
WORKING_PREFIX = "temp_sanitized_"

# An extension starts at the last dot, unless only dots stand before it.
_EXTENSION = r"(?s)\A\.*[^.].*(\.[^.]*)\z"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Extension with its dot, empty when there is none."""
    return F.regexp_extract(base_name(path), _EXTENSION, 1)


def stem(path: Column) -> Column:
    """Base name without extension."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(path)))


def without_suffix(name: Column, suffix: str = STRIPPED_SUFFIX) -> Column:
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - F.lit(len(suffix)))).otherwise(name)


def numbered_name(name: Column, number: Column) -> Column:
    """`a.json`, 2 -> `a_2.json`; the number 0 leaves the name as it is."""
    suffixed = F.concat(stem(name), F.lit("_"), number.cast("string"), extension(name))
    return F.when(number == 0, name).otherwise(suffixed)
