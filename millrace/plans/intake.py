"""Intake of a folder of export files: triage, catalog tables, and names for the junk folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import exports
from millrace.functions.paths import WORKING_PREFIX, base_name
from millrace.operators.joins import classify_by_substring
from millrace.operators.ordering import unique_names
from millrace.operators.routing import with_export_flag
from millrace.session import cut_lineage
from millrace.sources.delimited import decode_bytes


@dataclass(frozen=True)
class Catalog:
    docs: DataFrame
    pipelines: DataFrame
    steps: DataFrame
    links: DataFrame
    parameters: DataFrame
    settings: DataFrame
    junk: DataFrame


def files_with_text(files: DataFrame) -> DataFrame:
    """Binary rows -> text rows; undecodable files have a null text. Working copies are left out."""
    return decode_bytes(files.filter(~base_name(F.col("path")).startswith(WORKING_PREFIX)))


def catalog(files: DataFrame, key: str = "path", text: str = "text") -> Catalog:
    """All tables from one reading of the files: each text is tested and parsed once, and the records go to
    the shared folder, with the text only where it is junk. The tables read the fields they need."""
    flagged = with_export_flag(files.select(key, text), text, "_ok")
    fields = (*exports.STEP_FIELDS, *exports.LINK_FIELDS, *exports.PARAMETER_FIELDS, *exports.NAME_FIELDS)
    record = exports.export_record(F.col(text), tuple(dict.fromkeys(fields)))
    doc, rest = F.when(F.col("_ok"), record).alias("doc"), F.when(~F.col("_ok"), F.col(text)).alias(text)
    parsed = cut_lineage(flagged.select(key, "_ok", doc, rest), "parsed")
    docs, junk = parsed.filter("_ok").select(key, "doc"), parsed.filter("not _ok").select(key, text)
    steps = exports.minimised_steps(docs, key)
    return Catalog(
        docs=docs,
        pipelines=exports.pipeline_name(docs, key),
        steps=classify_by_substring(steps, "name", "class_id"),
        links=exports.links(docs, key),
        parameters=exports.parameters(docs, key),
        settings=exports.settings_long(steps, key),
        junk=junk,
    )


def steps_in_order(found: Catalog, key: str = "path") -> DataFrame:
    """Steps with their level in the graph: the order in which data flows, not the order in the file. An export holds its
    whole graph, so the levels come out of its record: no join, no shuffle, no loop of jobs."""
    return classify_by_substring(exports.minimised_steps(found.docs, key, with_level=True), "name", "class_id")


def quarantine_names(junk: DataFrame, order: list[str], taken: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Junk files with a name that is free in the quarantine folder."""
    named = junk.withColumn("file_name", base_name(F.col(key)))
    return unique_names(named, "file_name", order, taken)
