"""Levels of steps in a graph of links (CAT6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.session import Rounds, cut_lineage, new_shared_dir


def step_depth(
    links: DataFrame,
    graph: str = "pipeline",
    src: str = "src_id",
    dst: str = "dst_id",
    steps: DataFrame | None = None,
    step: str = "step_id",
) -> DataFrame:
    """`graph, step, depth`: length of the longest path that ends in each step; 0 for a start.

    Peels the graphs level by level: steps without incoming links are ready, their outgoing links
    are taken away, and steps that thereby lost their last incoming link are ready next. A level is
    one round over the links that are left, written to the shared folder, so the rounds number the
    levels of the deepest graph, and a graph that is done drops out. What the levels took goes to one
    table, so the result is planned alike for every depth. A step lies one below the last level that took a link to it away.
    Steps on or behind a cycle keep a link: their depth is null. `steps` adds steps that no link names.
    """
    left = cut_lineage(links.select(F.col(graph), F.col(src).alias("_src"), F.col(dst).alias("_dst")), "links")
    seen = left.select(graph, F.inline(F.array(_seen("_src", False), _seen("_dst", True))))
    if steps is not None:
        seen = seen.unionByName(steps.select(graph, F.col(step).alias("_step"), F.lit(False).alias("_waits")))
    starts = ready = _not_waiting(seen, graph)
    taken, level = new_shared_dir(links.sparkSession, "levels"), 0
    rounds = Rounds(links.sparkSession, "links")
    while True:
        marks = ready.select(graph, F.col("_step").alias("_src"), F.lit(True).alias("_gone"))
        counted = Observation()
        counts = F.count(F.lit(1)).alias("links"), F.count("_gone").alias("gone")
        marked = rounds.keep(left.join(marks, [graph, "_src"], "left").observe(counted, *counts))
        gone = marked.filter("_gone").select(graph, F.col("_dst").alias(step), F.lit(level).alias("_level"))
        gone.write.mode("append").parquet(taken)
        left = marked.filter("_gone is null").drop("_gone")
        found = counted.get
        if found["gone"] in (0, found["links"]):
            break
        ready = _not_waiting(
            marked.select(graph, F.col("_dst").alias("_step"), F.col("_gone").isNull().alias("_waits")), graph
        )
        level += 1

    incoming = links.sparkSession.read.schema(gone.schema).parquet(taken).unionByName(
        left.select(graph, F.col("_dst").alias(step), F.lit(None).cast("int").alias("_level"))
    )
    below = F.when(F.bool_and(F.col("_level").isNotNull()), F.max("_level") + 1).alias("depth")
    return (
        incoming.groupBy(graph, step)
        .agg(below)
        .unionByName(starts.select(graph, F.col("_step").alias(step), F.lit(0).alias("depth")))
    )


def levels_within(links: Column, steps: Column) -> Column:
    """`step -> depth` of a graph that one record holds: `links` is a list of `(src, dst)`, `steps` adds steps that no link names.

    The same levels as `step_depth`, null on or behind a cycle, by functions on the record's own list: every turn takes the
    links of a level away, and there are at most as many turns as links. No shuffle and no job of its own. Links and steps
    without a name say nothing. A graph that spans records is for `step_depth`.
    """
    named = F.filter(F.coalesce(links, F.array().cast("array<struct<src: string, dst: string>>")), lambda e: e["src"].isNotNull() & e["dst"].isNotNull())
    none = F.array().cast("array<struct<step: string, depth: int>>")
    start = F.struct(F.lit(1).alias("level"), named.alias("left"), none.alias("found"))

    def turn(state: Column, _: Column) -> Column:
        waiting = F.transform(state["left"], lambda e: e["dst"])
        gone = F.filter(state["left"], lambda e: ~F.array_contains(waiting, e["src"]))
        stay = F.filter(state["left"], lambda e: F.array_contains(waiting, e["src"]))
        below = F.transform(gone, lambda e: F.struct(e["dst"].alias("step"), state["level"].alias("depth")))
        after = F.struct((state["level"] + 1).alias("level"), stay.alias("left"), F.concat(state["found"], below).alias("found"))
        return F.when(F.size(state["left"]) == 0, state).otherwise(after)

    def levels(state: Column) -> Column:
        ends = F.flatten(F.transform(named, lambda e: F.array(e["src"], e["dst"])))
        every = F.array_distinct(F.concat(F.filter(F.coalesce(steps, F.array().cast("array<string>")), lambda s: s.isNotNull()), ends))

        def depth(step: Column) -> Column:
            waits = F.exists(state["left"], lambda e: e["dst"] == step)
            own = F.transform(F.filter(state["found"], lambda f: f["step"] == step), lambda f: f["depth"])
            return F.struct(step.alias("step"), F.when(~waits, F.coalesce(F.array_max(own), F.lit(0))).alias("depth"))

        return F.map_from_entries(F.transform(every, depth))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(named), F.lit(1))), start, turn, levels)


def _not_waiting(seen: DataFrame, graph: str) -> DataFrame:
    return seen.groupBy(graph, "_step").agg(F.bool_or("_waits").alias("_waits")).filter("not _waits")


def _seen(column: str, waits: bool):
    return F.struct(F.col(column).alias("_step"), F.lit(waits).alias("_waits"))
