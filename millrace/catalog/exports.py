"""Parse export documents and spread them into tables (CAT2-CAT5, CAT7-CAT9, JN5, PRJ11).

Each operator works inside one document's row, so none of them shuffles, except the two joins of
`edges_with_steps`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import stem, without_suffix
from millrace.functions.text import clean_pipeline_name
from millrace.operators.graph import levels_within

# The fields read from an export, in both layouts; names for what has none.
STEP_TYPE = (
    "struct<name: string, class_fqid: string, class_id: string, class_version: int, instance_fqid: string, "
    "instance_id: string, instance_version: int, property_map: variant, settings: variant, class_build_tag: string>"
)
LINK_TYPE = "struct<src_id: string, src_view_id: string, dst_id: string, dst_view_id: string, isGoto: boolean>"
EXPORT_FIELDS = {
    "class_fqid": "string",
    "snode_id": "string",
    "instance_id": "string",
    "instance_version": "int",
    "link_map": f"map<string, {LINK_TYPE}>",
    "link_serial": "int",
    "property_map": "variant",
    "info": "variant",
    "snaps": f"array<{STEP_TYPE}>",
    "snap_map": f"map<string, {STEP_TYPE}>",
    "path_id": "string",
    "path_snode": "string",
}
UNKNOWN_STEP = "Unknown"
UNLABELLED_STEP = "Snap"


STEP_FIELDS = ("snaps", "snap_map")
LINK_FIELDS = ("link_map",)
PARAMETER_FIELDS = ("property_map",)
NAME_FIELDS = ("property_map", "info")


def parse_exports(files: DataFrame, key: str = "path", text: str = "text", fields: Sequence[str] = ()) -> DataFrame:
    """`key, doc`: the export as a nested record, without its canvas data.

    Only the given top-level fields are parsed (all by default); the parser skips the others.
    """
    return files.select(F.col(key), export_record(F.col(text), fields).alias("doc"))


def export_record(text: Column, fields: Sequence[str] = ()) -> Column:
    kinds = ", ".join(f"{f}: {EXPORT_FIELDS[f]}" for f in fields or EXPORT_FIELDS)
    return F.from_json(text, f"struct<{kinds}>")


def steps(docs: DataFrame, key: str = "path") -> DataFrame:
    """One row per step, `position` counting from 0 in file order; the list layout wins over the map."""
    return docs.select(key, F.posexplode(listed_steps()).alias("position", "step"))


def listed_steps() -> Column:
    from_map = F.transform(F.map_entries("doc.snap_map"), lambda e: e["value"])
    return F.coalesce(F.col("doc.snaps"), from_map)


def levels(docs: DataFrame, key: str = "path") -> DataFrame:
    """`key, step_id, depth`: the level of every step along the links of its export, without a shuffle."""
    ends = F.transform(F.map_values("doc.link_map"), lambda e: F.struct(e["src_id"].alias("src"), e["dst_id"].alias("dst")))
    ids = F.transform(listed_steps(), lambda s: s["instance_id"])
    return docs.select(key, F.explode(levels_within(ends, ids)).alias("step_id", "depth"))


def step_name(step: Column) -> Column:
    """Own name, else the label, else the instance id, else a fixed name.

    A label that is no object leaves the step unknown; an explicit null label stays null.
    """
    name = F.coalesce(step["name"], F.lit(UNKNOWN_STEP))
    label = F.try_variant_get(step["property_map"], "$.info.label", "variant")
    value = F.try_variant_get(label, "$.value", "variant")
    is_object = F.coalesce(F.schema_of_variant(label).startswith("OBJECT"), F.lit(True))
    fallback = F.coalesce(step["instance_id"], F.lit(UNLABELLED_STEP))
    from_label = F.when(value.isNull(), fallback).otherwise(F.try_variant_get(value, "$", "string"))
    return F.when((name == UNKNOWN_STEP) & is_object, from_label).otherwise(name)


def settings_of(step: Column) -> Column:
    """Settings of either layout, an empty object when there are none."""
    inner = F.try_variant_get(step["property_map"], "$.settings", "variant")
    own = F.when(step["property_map"].isNull(), step["settings"]).otherwise(inner)
    return F.coalesce(own, F.parse_json(F.lit("{}")))


def minimised_steps(docs: DataFrame, key: str = "path", with_level: bool = False) -> DataFrame:
    """Only what tells what a step does: name, class, settings; and its level along the links, if asked for."""
    found, level = steps(docs, key), []
    if with_level:
        ends = F.transform(F.map_values("doc.link_map"), lambda e: F.struct(e["src_id"].alias("src"), e["dst_id"].alias("dst")))
        ids = F.transform(listed_steps(), lambda s: s["instance_id"])
        leveled = docs.select(key, "doc", levels_within(ends, ids).alias("levels"))
        found = leveled.select(key, "levels", F.posexplode(listed_steps()).alias("position", "step"))
        level = [F.try_element_at("levels", F.col("step.instance_id")).alias("depth")]
    return found.select(
        key,
        "position",
        F.col("step.instance_id").alias("step_id"),
        step_name(F.col("step")).alias("name"),
        F.coalesce("step.class_id", F.lit("")).alias("class_id"),
        settings_of(F.col("step")).alias("settings"),
        *level,
    )


def links(docs: DataFrame, key: str = "path") -> DataFrame:
    """Edges with the views they join."""
    edges = docs.select(key, F.explode(F.map_entries("doc.link_map")).alias("link"))
    return edges.select(
        key,
        F.col("link.key").alias("link_id"),
        "link.value.src_id",
        "link.value.src_view_id",
        "link.value.dst_id",
        "link.value.dst_view_id",
        F.coalesce("link.value.isGoto", F.lit(False)).alias("is_goto"),
    )


def edges_with_steps(edges: DataFrame, named_steps: DataFrame, key: str = "path") -> DataFrame:
    """Edges with the names and classes of both ends."""

    def end(side: str) -> DataFrame:
        return named_steps.select(
            key,
            F.col("step_id").alias(f"{side}_id"),
            F.col("name").alias(f"{side}_name"),
            F.col("class_id").alias(f"{side}_class"),
        )

    return edges.join(end("src"), [key, "src_id"], "left").join(end("dst"), [key, "dst_id"], "left")


# The fields of a declared parameter; each holds its value in an inner field.
_PARAMETER = ", ".join(
    f"{name}: struct<value: {kind}>"
    for name, kind in [
        ("key", "string"),
        ("value", "string"),
        ("data_type", "string"),
        ("description", "string"),
        ("required", "boolean"),
        ("capture", "boolean"),
    ]
)


def parameters(docs: DataFrame, key: str = "path") -> DataFrame:
    """Declared parameters, in order of declaration."""
    table = F.try_variant_get("doc.property_map", "$.settings.param_table.value", f"array<struct<{_PARAMETER}>>")
    rows = docs.select(key, F.posexplode(table).alias("position", "p"))
    return rows.select(
        key,
        "position",
        F.col("p.key.value").alias("name"),
        F.col("p.value.value").alias("value"),
        F.col("p.data_type.value").alias("data_type"),
        F.col("p.description.value").alias("description"),
        F.col("p.required.value").alias("required"),
        F.col("p.capture.value").alias("capture"),
    )


def settings_long(named_steps: DataFrame, key: str = "path") -> DataFrame:
    """A row per setting: is it an expression, and its value as text (JSON for lists and objects)."""
    spread = named_steps.lateralJoin(
        named_steps.sparkSession.tvf.variant_explode(F.col("settings").outer()).alias("setting")
    )
    value = F.try_variant_get("setting.value", "$.value", "variant")
    is_wrapped = F.coalesce(F.schema_of_variant("setting.value").startswith("OBJECT"), F.lit(False))
    return spread.select(
        key,
        "position",
        "step_id",
        F.col("setting.key").alias("setting"),
        F.coalesce(F.try_variant_get("setting.value", "$.expression", "boolean"), F.lit(False)).alias("is_expression"),
        F.when(is_wrapped, value).otherwise(F.col("setting.value")).cast("string").alias("value"),
    )


def pipeline_name(docs: DataFrame, key: str = "path") -> DataFrame:
    """`key, pipeline`: label, else title, else inner label, else the file's base name."""

    def text(source: str, path: str) -> Column:
        return F.nullif(F.try_variant_get(source, path, "string"), F.lit(""))

    given = F.coalesce(
        text("doc.property_map", "$.info.label.value"),
        text("doc.info", "$.title"),
        text("doc.info", "$.label.value"),
    )
    return docs.select(
        key, F.coalesce(clean_pipeline_name(given), without_suffix(stem(F.col(key)))).alias("pipeline")
    )


def step_layout(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Per file: which layout, how many steps, and the keys of its first step and of its properties."""
    body = F.from_json(F.col(text), "struct<snaps: array<string>, snap_map: map<string, string>, property_map: string>")
    listed = F.col("b.snaps")
    mapped = F.map_values("b.snap_map")
    stored = F.coalesce(listed, mapped)
    return files.select(key, body.alias("b")).select(
        key,
        F.when(listed.isNotNull(), "list").when(mapped.isNotNull(), "map").alias("layout"),
        F.coalesce(F.size(stored), F.lit(0)).cast("bigint").alias("n_steps"),
        F.array_join(F.json_object_keys(F.get(stored, F.lit(0))), ",").alias("first_step_keys"),
        F.array_join(F.json_object_keys("b.property_map"), ",").alias("property_keys"),
    )
