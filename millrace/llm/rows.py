"""Small helpers for rows: names that clash with nothing, word counts, positions in a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as it takes to differ from all columns, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that `chosen` names by `(id, hash of the text, number of rows)`, one row of each name."""
    own, hashed, n = (fresh(docs, name) for name in ("id", "hash", "copies"))
    match = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text_col)) == F.col(hashed))
    kept = docs.join(chosen.toDF(own, hashed, n), match)
    again = kept.where(F.col(n) > 1).dropDuplicates([own, hashed])
    return kept.where(F.col(n) == 1).unionByName(again).drop(own, hashed, n)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def early_by_hash(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The rows below a bound on a hash of `key` that leaves about four times `n`; repeated rows stay together."""
    total = df.count()
    return df.where(F.xxhash64(*key).cast("double") / F.lit(2.0**64) + 0.5 < F.lit(4.0 * n / max(total, 1)))


def first_by_hash(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The `n` rows that come first by a hash of `key`, or all if there are fewer; equal hashes go by the key. A bound on
    the hash comes before the sort, so tasks hand on few rows however many there are."""
    return early_by_hash(df, n, *key).orderBy(F.xxhash64(*key), *key).limit(n)


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """The rows with their position from 0 by `order`, which must be unique. The table is cut into ranges; a row is
    numbered within its range, and what earlier ranges hold is added from a table with a row per range."""
    part = fresh(df, "part")
    cut = cut_lineage(df.repartitionByRange(order).withColumn(part, F.spark_partition_id()), "ranges")
    held = cut.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    start = held.select(F.col(part), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    return cut.withColumn(name, within).join(start, part).withColumn(name, F.col(name) + F.col("start")).drop("start", part)
