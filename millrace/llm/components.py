"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import Rounds

#: So many links at most are joined and grouped by one task, without shuffles; more are dealt out.
TASK_LINKS = 1 << 17


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """`(node, root)` for every node of the links that is not its component's smallest one.

    Alternates two steps that keep the components and shorten the paths: every node hands its larger
    neighbours to its smallest neighbour, then its smaller ones. The number of rounds grows with the
    logarithm of the longest path. A round shuffles the links left, each step's minimum is combined
    before the shuffle, and its rows go to a table in the shared folder, so a lost executor costs one
    step. Up to `task_links` links, a round is one task for each step and has no shuffle at all. Links with a null end and links of a node to itself say nothing and are passed over.
    """
    pair = [F.col(a).alias("u"), F.col(b).alias("v")]
    edges = links.select(*pair).where(F.col(a) != F.col(b))
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    rounds = Rounds(links.sparkSession, "links")
    edges = rounds.keep(edges)
    before = _state(edges)
    while before[0]:
        dealt = (lambda df: df.coalesce(1)) if before[0] <= task_links else (lambda df: df)
        both = dealt(edges).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = dealt(rounds.keep(large.where("u <> v").distinct()))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = rounds.keep(dealt(small).where("u <> v").distinct())
        state = _state(edges)
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """The number of links, and a sum that tells other links apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
