"""Mixing of sources to target weights: whole copies by rate, and one more by a hash of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.rows import fresh, numbered, word_count
from millrace.session import cut_lineage

#: A source's target stops at so many times its size.
MOST = 3
#: Weights of the sources by name, from the first on and again.
WEIGHTS = (1, 2, 3)
SEED = 17


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """`(source, source_size, target, rate)` of every source, null among them.

    Sizes count words. Sources in the order of their names' code points, null last, weigh `weights` in turn and share
    the size of all. A target stops at `most` times its source's size and the excess is shared out anew by weight: each
    round is one aggregation over the sources, and the driver holds three numbers.
    """
    size = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("n"))
    table = size.groupBy("source").agg(F.sum("n").alias("source_size"))
    place = fresh(table, "place")
    order = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    named = numbered(table.withColumn("order", order), F.col("order"), place)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col(place) % len(weights) + 1).cast("int")).cast("long")
    table = cut_lineage(named.select("source", "source_size", weight.alias("weight")), "sources")
    cap = most * F.col("source_size")
    free, free_weight = None, None
    while True:
        full = F.lit(False) if free is None else F.lit(free) * F.col("weight") / F.lit(free_weight) > cap
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        now = ((row["all"] or 0) - row["full"], max(row["weight"], 1))
        if now == (free, free_weight):
            break
        free, free_weight = now
    shared = F.lit(free) * F.col("weight") / F.lit(free_weight)
    target = F.least(shared, cap.cast("double"))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the key and the seed alone."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def with_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of `docs` with `(size, source_size, target, copies)` in a struct `mix` (named apart from any column).

    A document is taken floor(rate) times, and once more if its draw lies below the rest; so no document exceeds `most`
    copies, and reruns agree. The rates are joined to the rows by source: Spark sends them to all tasks if it measures
    them to be small, and splits the partitions of large sources otherwise. Null texts have size 0; rows that repeat
    an id share their draw; a source without words has rate 0; an empty table gives none.
    """
    rates = source_rates(docs, source_col, text_col, weights, most)
    found = fresh(docs, "rates")
    rates = rates.select(F.struct("source", "source_size", "target", "rate").alias(found))
    rate = F.col(f"{found}.rate")
    whole = F.floor(rate)
    copies = whole + F.when(draw(F.col(id_col), seed) < rate - whole, 1).otherwise(0)
    mix = F.struct(word_count(F.col(text_col)).alias("size"), F.col(f"{found}.source_size"), F.col(f"{found}.target"), copies.cast("long").alias("copies"))
    joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col(f"{found}.source")))
    return joined.select(*docs.columns, mix.alias(fresh(docs, "mix")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture: the rows of `docs`, each as often as it is taken."""
    plan = with_copies(docs, **options)
    mix = plan.columns[-1]
    return plan.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(f"{mix}.copies").cast("int"))).alias(fresh(plan, "copy"))).select(*docs.columns)
