"""Tests on JSON text (RTE4). All built-in functions, so triage stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two keys that mark a pipeline export.
LAYOUT_KEYS = ("snaps", "snap_map")


def _as_object_value(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit('{"k":'), text, F.lit("}")))


def _is_one_list_entry(text: Column) -> Column:
    return F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1


def is_json(text: Column) -> Column:
    """One whole JSON value with nothing after it.

    The parsers stop after the first value and do not mind what follows, so the text is read as the
    value of an object (the strict parser) and as the entry of a list (a quick count). A leftover
    would have to go on with a comma in both, and then be a list entry and a key with its value at
    once, which no text is.
    """
    return F.coalesce(_as_object_value(text).isNotNull() & _is_one_list_entry(text), F.lit(False))


def is_json_object(text: Column) -> Column:
    return is_json(text) & F.json_object_keys(text).isNotNull()


def is_pipeline_export(text: Column, keys: tuple[str, ...] = LAYOUT_KEYS) -> Column:
    """A JSON object that has one of the layout keys at its top level; a null entry counts as present."""
    entries = F.try_variant_get(_as_object_value(text), "$.k", "map<string, variant>")
    has_key = F.arrays_overlap(F.map_keys(entries), F.array(*[F.lit(k) for k in keys]))
    return F.coalesce(_is_one_list_entry(text) & has_key, F.lit(False))
