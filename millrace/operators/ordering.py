"""Ordered operators (WIN1-WIN5, SRT1, LIM1, LIM2).

A window over a key sorts all rows of the key in one task. So that a key with a large share of all
rows does not end up there, `running` cuts the whole frame into ranges of (keys, order): Spark
finds the cuts by sampling, whatever the types and their distribution. Windows run within (key,
range), and what earlier ranges hold of a key (counts, last values) is added from a table of the
few keys that lie across a cut. The result is exact for every way of cutting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.paths import extension, numbered_name, stem
from millrace.session import cut_lineage


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    row_number: str | None = None,
    previous: Mapping[str, str] | None = None,
    count_before: Mapping[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Window columns per key, in ascending order of `order` (end it with a tie-breaker).

    `row_number` names a count from 1; `previous` and `count_before` map a new column to the one
    whose last value, or number of values, in the rows before it takes. Without keys the whole frame
    is one sequence. Any type that Spark can order will do. Only rows that are equal in keys and
    order are kept together.

    The rows are dealt out into `ranges` (by default as many as the session's shuffles have) and
    written once to the shared folder, since the cuts come from a sample; Spark computes the
    input twice for that. Write an input that is costly first (`session.cut_lineage`).
    """
    previous, count_before = dict(previous or {}), dict(count_before or {})
    names = [F.col(f"`{k}`") for k in keys]
    parts = [ranges] if ranges else []
    dealt = cut_into_ranges(df, keys, order, *parts)

    key, sequence = F.struct(F.lit(0).alias("_"), *names), F.struct(*[F.col(f"`{o}`") for o in order])
    ends = dealt.groupBy("_range").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    # One row per range. At most one key lies across each cut.
    following = F.lead("_low").over(Window.orderBy("_range"))
    across = ends.select("_high", following.alias("_next")).filter(F.col("_high").eqNullSafe(F.col("_next")))
    across = cut_lineage(across.select(F.col("_high").alias("_across")).distinct(), "keys-across")
    totals = (
        dealt.join(across, key.eqNullSafe(F.col("_across")))
        .groupBy("_across", "_range")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.max_by(F.col(f"`{c}`"), sequence).alias(f"_last_{n}") for n, c in previous.items()],
            *[F.count(F.col(f"`{c}`")).alias(f"_count_{n}") for n, c in count_before.items()],
        )
    )
    by_range = Window.partitionBy("_across").orderBy("_range")
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    # At most two rows per range, so of a size that Spark knows before it joins them.
    carried = cut_lineage(
        totals.select(
            "_across",
            F.col("_range").alias("_carry_range"),
            F.sum("_rows").over(earlier).alias("_rows"),
            *[F.lag(f"_last_{n}").over(by_range).alias(f"_last_{n}") for n in previous],
            *[F.sum(f"_count_{n}").over(earlier).alias(f"_count_{n}") for n in count_before],
        ),
        "carried",
    )

    whole = dealt.join(carried, (F.col("_range") == F.col("_carry_range")) & key.eqNullSafe(F.col("_across")), "left")
    local = Window.partitionBy(*names, "_range").orderBy(*[F.col(f"`{o}`") for o in order])
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(local)
    columns = {}
    if row_number:
        columns[row_number] = place.cast("bigint") + F.coalesce("_rows", F.lit(0))
    for name, source in previous.items():
        columns[name] = F.when(place == 1, F.col(f"_last_{name}")).otherwise(F.lag(F.col(f"`{source}`")).over(local))
    for name, source in count_before.items():
        columns[name] = F.count(F.col(f"`{source}`")).over(before) + F.coalesce(f"_count_{name}", F.lit(0))
    return whole.select(*[F.col(f"`{c}`") for c in df.columns], *[value.alias(name) for name, value in columns.items()])


def cut_into_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], *number: int) -> DataFrame:
    """The rows as a written table with `_range`: a number that never falls as (keys, order) rise."""
    by = [F.col(f"`{c}`") for c in (*keys, *order)]
    dealt = df.repartitionByRange(*number, *by).withColumn("_range", F.spark_partition_id())
    return cut_lineage(dealt, "ranges")


def unique_names(
    df: DataFrame,
    name: str,
    order: Sequence[str],
    taken: DataFrame | None = None,
    column: str = "unique_name",
    ranges: int | None = None,
) -> DataFrame:
    """Later files of a name, in order of arrival, get `_1`, `_2`, ... before the extension.

    `taken` holds names (in a column called as `name`) that exist already. A name of the batch or
    an existing one is never given out as a numbered name: those numbers are passed over. Whether
    there are any is looked up at once; if so, the numbered rows are written to the shared folder.
    """
    wished = running(df, [name], order, row_number="_wish", ranges=ranges)
    # The first file of a free name needs no number; for an existing name even the first does.
    if taken is None:
        wished = wished.withColumn("_wish", F.col("_wish") - 1)
    else:
        existing = taken.select(name).distinct().withColumn("_exists", F.lit(True))
        wish = F.col("_wish") - F.when(F.col("_exists"), 0).otherwise(1)
        wished = wished.join(existing, name, "left").withColumn("_wish", wish).drop("_exists")
    blocked = cut_lineage(_blocked_numbers(df.select(name), taken, name))
    shift = F.lit(0)
    if not blocked.isEmpty():
        # The i-th blocked number k (from 1) pushes wish w on by one when k - i < w. So the wishes
        # are put in one line with these thresholds, and each counts the thresholds before it.
        ranked = running(blocked, [name], ["_number"], row_number="_i", ranges=ranges)
        thresholds = cut_lineage(
            ranked.select(name, (F.col("_number") - F.col("_i") + 1).alias("_at"), F.lit(1).alias("_blocked"))
        )
        line = cut_lineage(wished).withColumn("_at", F.col("_wish")).unionByName(thresholds, allowMissingColumns=True)
        line = line.withColumn("_last", F.col("_wish").isNotNull().cast("int"))
        wished = running(
            line, [name], ["_at", "_last"], count_before={"_shift": "_blocked"}, ranges=ranges
        ).filter("_last = 1")
        shift = F.when(F.col("_wish") > 0, F.col("_shift")).otherwise(0)
    return wished.select(*df.columns, numbered_name(F.col(name), F.col("_wish") + shift).alias(column))


def _blocked_numbers(names: DataFrame, taken: DataFrame | None, name: str) -> DataFrame:
    """`name, _number`: where `base_7.ext` occurs or exists, the number 7 is blocked for `base.ext`,
    if that occurs."""
    distinct = names.distinct()
    occupied = distinct if taken is None else distinct.union(taken.select(name)).distinct()
    # Longer numbers than the pattern's 18 digits are passed over: no count reaches them.
    body = stem(F.col(name))
    number = F.regexp_extract(body, r"(?s)_([1-9][0-9]{0,17})\z", 1)
    base = F.concat(F.regexp_replace(body, r"_[1-9][0-9]{0,17}\z", ""), extension(F.col(name)))
    numbered = occupied.filter(number != "").select(base.alias(name), number.cast("bigint").alias("_number"))
    return numbered.join(distinct, name, "left_semi")


def sort_ascending(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() for c in columns])


def limit(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """Record cap; with an order, the first rows of it, in that order. Spark keeps the best `n` rows of
    each task, or sorts the frame where `n` is above `spark.sql.execution.topKSortFallbackThreshold`."""
    return (df.orderBy(*order) if order else df).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int = 1, offset: int = 0) -> DataFrame:
    """The last `n` documents, leaving out the very last `offset`, in ascending order."""
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(n + offset).offset(offset)
    return last.orderBy(*[F.col(c).asc() for c in order])
