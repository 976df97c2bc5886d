"""Joins (JN1-JN4).

No side is ever forced to be broadcast: Spark does it where its size, known or measured while
running, is below `spark.sql.autoBroadcastJoinThreshold`, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def join_equi(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on, "inner")


def semi_join(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(ids, on, "left_semi")


def anti_join(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in the other table; a null key is in no table."""
    return df.join(ids, on, "left_anti")


def lookup(
    df: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    pass_through: bool = True,
    keep_unmatched: bool = True,
) -> DataFrame:
    """One query for all documents: each is enriched by its result rows.

    Without `pass_through` only the result's fields are left; documents without a result stay with
    nulls unless `keep_unmatched` is off.
    """
    joined = df.join(table, on, "left" if keep_unmatched else "inner")
    return joined if pass_through else joined.select(*table.columns)


# The step kinds that have a template, in the order of search.
STEP_KINDS = ("simpleread", "csvparser", "sqlserver-insert", "mapper")


def first_contained(text: Column, patterns: Sequence[str] = STEP_KINDS) -> Column:
    """The first pattern, in list order, that occurs in the lower-case text; null when none does."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in patterns])


#: Length of the pieces by which patterns are looked up.
PIECE = 5
#: A text is cut into runs of letters and digits, and runs of anything else.
WORD, OTHER = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def _pieces(text: Column, n: int) -> Column:
    """The distinct runs of `n` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _longest_run(text: Column, kind: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"{kind}+"), F.lit(0))
    return F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]


def _holding(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """`(run, part)` of every part that occurs in a run. Each part is looked up by the one of its pieces that the fewest
    runs have (a shorter part by itself), so runs meet only parts with which they share a rare piece; what meets is searched."""
    size = F.least(F.length("part"), F.lit(PIECE))
    by_size = F.coalesce(*[F.when(size == n, _pieces(F.col("part"), n)) for n in range(1, PIECE + 1)], F.array(F.lit("")))
    wanted = parts.select("part", F.explode(by_size).alias("piece"))
    # runs give pieces of those lengths only that parts ask for
    sizes = [r[0] for r in wanted.select(F.length("piece")).distinct().collect()]  # at most PIECE + 1
    own = F.flatten(F.array(*[F.array(F.lit("")) if n == 0 else _pieces(F.col("run"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    pieces = runs.select("run", F.explode(own).alias("piece"))
    counts = pieces.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "piece", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("rare"))
    index = rarest.where("rare.n > 0").select("part", "rare.piece")
    return pieces.join(index, "piece").where(F.contains("run", "part")).select("run", "part")


def classify_by_patterns(df: DataFrame, text: Column, patterns: DataFrame, key: str, column: str = "kind") -> DataFrame:
    """The rows with the kind of the first pattern that occurs in the lower-case text; null when none does.

    `patterns` has `pattern, priority, kind`; the least priority wins, then the smaller pattern. `key` names rows of `df`.
    Texts are cut into runs of letters and digits, and of anything else where a pattern has nothing else. The different runs
    are written to the shared folder; each pattern's longest run is searched for in them, once for all texts, and texts get
    what was found by equi-joins. Patterns of several runs are then searched for in the texts that have that one. Null texts,
    keys and patterns match nothing; an empty pattern is in every text.
    """
    known = patterns.where("pattern is not null").select(F.lower("pattern").alias("pattern"), "priority", "kind")
    known = known.groupBy("pattern").agg(F.min(F.struct("priority", "kind")).alias("first"))
    longest = {kind: _longest_run(F.col("pattern"), kind) for kind in (WORD, OTHER)}
    known = known.withColumn("part", F.coalesce(*longest.values(), F.lit("")))
    cut = F.when(F.col("part") == "", "").when(longest[WORD].isNotNull(), WORD).otherwise(OTHER)
    shapes = known.groupBy(cut.alias("cut")).agg(F.min(F.length("part")).alias("least"), F.bool_or(F.col("part") != F.col("pattern")).alias("more"))
    shapes = shapes.collect()  # at most three
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.lower(text).alias("_text")).where("_text is not null")
    # shorter runs hold no pattern
    own = [F.regexp_extract_all("_text", F.lit(f"{r.cut}{{{r.least},}}"), F.lit(0)) if r.cut else F.array(F.lit("")) for r in shapes]
    runs = texts.select("_key", F.explode(F.array_distinct(F.flatten(F.array(*own))) if own else F.array().cast("array<string>")).alias("run"))
    different = cut_lineage(runs.select("run").distinct(), "runs")
    met = cut_lineage(_holding(different, known.select("part").distinct()), "met").join(known, "part")
    first = F.min(F.struct("first.priority", "pattern", "first.kind")).alias("_best")
    single = met.where("part = pattern").groupBy("run").agg(first)
    best = runs.join(single, "run").select("_key", "_best")
    if any(r.more for r in shapes):
        asked = runs.join(met.where("part <> pattern").select("run", "pattern", "first"), "run").select("_key", "pattern", "first").distinct()
        found = texts.join(asked, "_key").where(F.contains("_text", "pattern"))
        best = best.unionByName(found.select("_key", F.struct("first.priority", "pattern", "first.kind").alias("_best")))
    best = best.groupBy("_key").agg(F.min("_best").alias("_best"))
    joined = df.join(best, F.col(key) == F.col("_key"), "left")
    return joined.select(*df.columns, F.col("_best.kind").alias(column))


def classify_by_substring(
    df: DataFrame, name: str, class_id: str, patterns: Sequence[str] = STEP_KINDS, column: str = "kind"
) -> DataFrame:
    """Kind of each step by its name and class; an ordered list of patterns needs no join."""
    return df.withColumn(column, first_contained(F.concat(F.col(name), F.col(class_id)), patterns))
