"""Spark result against DuckDB result: names, types, and rows without regard to order."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

KINDS = {
    T.StringType: "VARCHAR",
    T.LongType: "BIGINT",
    T.IntegerType: "INTEGER",
    T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN",
    T.TimestampNTZType: "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None. Texts are compared whole."""
    names = sorted(df.columns)
    wanted = con.sql(sql)
    if sorted(wanted.columns) != names:
        return f"columns {names} <> {sorted(wanted.columns)}"
    kinds = dict(zip(wanted.columns, map(str, wanted.types)))
    notes = []
    for field in df.schema:
        kind = KINDS.get(type(field.dataType), field.dataType.simpleString())
        if kind != kinds[field.name] and kinds[field.name] != '"NULL"':
            notes.append(f"type of {field.name}: {kind} <> {kinds[field.name]}")
    got = sorted((tuple(row) for row in df.select(*names).collect()), key=repr)
    order = [wanted.columns.index(n) for n in names]
    want = sorted((tuple(row[i] for i in order) for row in wanted.fetchall()), key=repr)
    if len(got) != len(want):
        notes.append(f"{len(got)} <> {len(want)} rows")
    for a, b in zip(got, want):
        if a != b:
            notes.append(f"\n   got  {str(a)[:600]}\n   want {str(b)[:600]}")
            break
    return "; ".join(notes) or None
