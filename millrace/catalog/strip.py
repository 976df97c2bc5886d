"""Drop canvas data from export documents (CAT1)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut_lineage, new_shared_dir

# What to drop at the root, in each step, and at every depth of a step.
ROOT_KEYS = ("render_map", "job_stats")
STEP_KEYS = ("view",)
DEEP_KEYS = ("view", "x", "y", "height", "width", "color", "render_map", "detail_map")


def slim_json():
    """The function over Arrow batches; all it needs is inside, so executors need no copy of this package."""
    root_keys, step_keys, deep_keys = set(ROOT_KEYS), set(STEP_KEYS), set(DEEP_KEYS)
    after_blanks = re.compile(r"[ \t\n\r]*").match

    def slim(text):
        try:
            try:
                return compact(slimmed(json.loads(text)), json_text)
            except RecursionError:
                return compact(slimmed(nested(text)), nested_text)
        except (TypeError, ValueError):
            # No JSON, or half of a surrogate pair, which no text can hold.
            return None

    def compact(doc, write):
        if not isinstance(doc, dict):
            return None
        text = write(doc)
        text.encode()
        return text

    def json_text(node):
        return json.dumps(node, ensure_ascii=False, separators=(",", ":"))

    def drop(node, keys):
        if isinstance(node, dict):
            for key in keys & node.keys():
                del node[key]

    def slimmed(doc):
        if not isinstance(doc, dict):
            return doc
        drop(doc, root_keys)
        if isinstance(doc.get("snaps"), list):
            for step in doc["snaps"]:
                drop(step, step_keys)
        if isinstance(doc.get("snap_map"), dict):
            left = list(doc["snap_map"].values())
            while left:
                node = left.pop()
                drop(node, deep_keys)
                if isinstance(node, (dict, list)):
                    left.extend(node.values() if isinstance(node, dict) else node)
        return doc

    # For documents deeper than the recursion of the json module goes: the same values and texts with a stack.

    def nested(text):
        scalar = json.JSONDecoder().scan_once
        root = []
        inside, keys = [root], [None]

        def key_at(at):
            if text[at : at + 1] != '"':
                raise ValueError("no key")
            key, at = scalar(text, at)
            at = after_blanks(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            return key, after_blanks(text, at + 1).end()

        def put(value):
            if isinstance(inside[-1], dict):
                inside[-1][keys[-1]] = value
            else:
                inside[-1].append(value)

        at = after_blanks(text, 0).end()
        while True:
            start = text[at : at + 1]
            if start in ("{", "["):
                node = {} if start == "{" else []
                put(node)
                inside.append(node)
                keys.append(None)
                at = after_blanks(text, at + 1).end()
                if text[at : at + 1] != ("}" if start == "{" else "]"):
                    if start == "{":
                        keys[-1], at = key_at(at)
                    continue
            else:
                try:
                    value, at = scalar(text, at)
                except StopIteration:
                    raise ValueError("no value") from None
                put(value)
                at = after_blanks(text, at).end()
            while len(inside) > 1 and text[at : at + 1] == ("}" if isinstance(inside[-1], dict) else "]"):
                inside.pop()
                keys.pop()
                at = after_blanks(text, at + 1).end()
            if len(inside) == 1:
                if at < len(text):
                    raise ValueError("more than one value")
                return root[0]
            if text[at : at + 1] != ",":
                raise ValueError("no comma")
            at = after_blanks(text, at + 1).end()
            if isinstance(inside[-1], dict):
                keys[-1], at = key_at(at)

    def nested_text(doc):
        # What is still to be written, last first: texts as they are, or values.
        left, done = [(False, doc)], []
        while left:
            is_text, node = left.pop()
            if is_text:
                done.append(node)
            elif isinstance(node, dict):
                left.append((True, "}"))
                for i, (key, value) in reversed(list(enumerate(node.items()))):
                    left.append((False, value))
                    left.append((True, ("," if i else "") + json_text(key) + ":"))
                left.append((True, "{"))
            elif isinstance(node, list):
                left.append((True, "]"))
                for i, value in reversed(list(enumerate(node))):
                    left.append((False, value))
                    if i:
                        left.append((True, ","))
                left.append((True, "["))
            else:
                done.append(json_text(node))
        return "".join(done)

    def slim_batch(texts: pd.Series) -> pd.Series:
        return texts.map(slim)

    return F.pandas_udf(slim_batch, T.StringType())


def strip_layout(files: DataFrame, text: str = "text") -> DataFrame:
    """The documents as compact JSON without canvas data, in their own key order; null for other texts.

    Settings nest to any depth and keep their order, which no built-in function can rewrite (a variant sorts its
    keys, and Spark's JSON parser ends at 1,000 levels), so this is a function over Arrow batches: one pass, no
    shuffle. Documents deeper than the json module's recursion goes are read and written with a stack. Analyses need no stripped text: `parse_exports` does not
    read the canvas, and `layout_free_values` filters it.
    """
    return files.withColumn(text, slim_json()(F.col(text)))


def layout_free_values(named_steps: DataFrame, levels: int = 6, key: str = "path") -> DataFrame:
    """`key, position, step_id, place, value`: each innermost setting value by its place (`a.b[0].c`).

    One generator per level of nesting, no shuffle. `levels` are taken in one pass; its write tells
    whether values lie deeper, and only those go through another one. A step without settings has one
    row with an empty place; one that has canvas keys only has none.
    """
    spark = named_steps.sparkSession
    own = [key, "position", "step_id"]
    found = new_shared_dir(spark, "values")
    rows = named_steps.select(*own, F.lit("").alias("_at"), F.col("settings").alias("_node"))
    while True:
        for _ in range(levels):
            rows = _one_level(rows, own)
        kind = F.schema_of_variant("_node")
        deep = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>"))
        seen = Observation()
        rows = rows.withColumn("_deep", F.coalesce(deep, F.lit(False)))
        rows = cut_lineage(rows.observe(seen, F.count_if("_deep").alias("deep")), "values")
        done = rows.filter("not _deep").select(*own, F.col("_at").alias("place"), F.col("_node").cast("string").alias("value"))
        done.write.mode("append").parquet(found)
        if not seen.get["deep"]:
            return spark.read.schema(done.schema).parquet(found)
        rows = rows.filter("_deep").drop("_deep")


def _one_level(rows: DataFrame, own: list[str]) -> DataFrame:
    # A value that is no list or object, or is empty, gives one row without key and value.
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("_node").outer()).alias("e"))
    rows = rows.filter(F.col("e.key").isNull() | ~F.col("e.key").isin(*DEEP_KEYS))
    in_list = F.concat("_at", F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))
    in_object = F.concat_ws(".", F.nullif(F.col("_at"), F.lit("")), "e.key")
    inner = F.col("e.value").isNotNull()
    return rows.select(
        *own,
        F.when(inner, F.when(F.col("e.key").isNull(), in_list).otherwise(in_object)).otherwise(F.col("_at")).alias("_at"),
        F.when(inner, F.col("e.value")).otherwise(F.col("_node")).alias("_node"),
    )
