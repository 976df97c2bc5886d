"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.rows import fresh
from millrace.session import cut_lineage

SHARD_BYTES = 64 << 20
#: Bits of a row's hash.
BITS = 60
#: Bits by which the directory grows when a cell of it is too large.
STEP = 12


def row_hash(id_col: str, text_col: str) -> Column:
    """60 bits from the id and the text."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(BITS // 4)), 16, 10).cast("long")


def _prefix(h: Column, depth: int | Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, shard_bytes: int) -> list[DataFrame]:
    """Directories `(cell_depth, cell, depth)`: for each prefix of `cell_depth` bits, the bits of its bucket.

    `rows` has `(h, bytes)`. A bucket is a prefix whose rows fit while those of the prefix one bit shorter don't. Sizes
    of all prefixes of up to `STEP` bits come out of one aggregation by the longest one; only the cells that are
    still too large are looked at again, `STEP` bits deeper. The last one holds cells of all `BITS` bits that can't be split.
    """
    found, depth, left = [], 0, rows
    while True:
        top, depth = depth, min(depth + STEP, BITS)
        cells = cut_lineage(left.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        levels = F.explode(F.sequence(F.lit(top), F.lit(depth)))
        nodes = cells.select("cell", "bytes", levels.alias("d")).withColumn("node", F.call_function("shiftright", "cell", F.lit(depth) - F.col("d")))
        sizes = nodes.groupBy("d", "node").agg(F.sum("bytes").alias("total")).where(F.col("total") <= shard_bytes)
        fits = nodes.join(sizes, ["d", "node"]).groupBy("cell").agg(F.min("d").alias("depth"))
        every = cut_lineage(cells.join(fits, "cell", "left").select(F.lit(depth).alias("cell_depth"), "cell", "depth"), "directory")
        found.append(every)
        large = every.where("depth is null")
        if depth == BITS or large.isEmpty():
            return found
        left = left.join(large.select(F.col("cell").alias("__cell")), _prefix(F.col("h"), depth) == F.col("__cell"), "left_semi")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of `docs` with a struct `shard` (named apart from any column): `(name, depth, bytes)`, the bucket's bits
    as text, their number, and the row's bytes of text in UTF-8.

    Only buckets over the limit are split, each on its next bit, until every shard fits. Rows alike in id and text agree
    in all bits; where they exceed the limit by themselves they are numbered and dealt out to shards `bits.0`,
    `bits.1` and so on, as many to each as fit. A single row above the limit is a shard of its own. Null texts have no
    bytes; a table that fits is one shard with an empty name; an empty table gives no rows.
    """
    h, size = fresh(docs, "h"), fresh(docs, "bytes")
    rows = docs.select("*", row_hash(id_col, text_col).alias(h), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias(size))
    narrow = rows.select(F.col(h).alias("h"), F.col(size).alias("bytes"))
    name = fresh(docs, "shard")

    def bits(depth: Column, hash_: Column) -> Column:
        return F.lpad(F.when(depth > 0, F.conv(F.call_function("shiftright", hash_, (BITS - depth).cast("int")).cast("string"), 10, 2)).otherwise(""), depth, "0")

    def shard(text: Column, depth: Column) -> Column:
        return F.struct(text.alias("name"), depth.cast("int").alias("depth"), F.col(size).alias("bytes")).alias(name)

    found = directory(narrow, shard_bytes)
    parts, left = [], rows
    for k, table in enumerate(found):
        cell_depth = min((k + 1) * STEP, BITS)
        cell, depth = fresh(rows, "cell"), fresh(rows, "depth")
        table = table.select(F.col("cell").alias(cell), F.col("depth").alias(depth))
        placed = left.join(table, _prefix(F.col(h), cell_depth) == F.col(cell))
        parts.append(placed.where(F.col(depth).isNotNull()).select(*docs.columns, shard(bits(F.col(depth), F.col(h)), F.col(depth))))
        left = placed.where(F.col(depth).isNull()).select(*rows.columns)
    if len(found) * STEP >= BITS:
        number = F.row_number().over(Window.partitionBy(h).orderBy(size)) - 1
        each = F.greatest(F.floor(F.lit(shard_bytes) / F.greatest(F.col(size), F.lit(1))), F.lit(1))
        text = F.concat(bits(F.lit(BITS), F.col(h)), F.lit("."), F.floor(number / each).cast("string"))
        parts.append(left.withColumn(name, shard(text, F.lit(BITS))).select(*docs.columns, name))
    return reduce(DataFrame.unionByName, parts)
