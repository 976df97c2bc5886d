"""Projections and mapping (PRJ1-PRJ11, UDF1, UDF2)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "$"


def mapper(
    df: DataFrame,
    mapping: Sequence[tuple[str, Column | str]],
    pass_through: bool = False,
    root: str = ROOT,
    null_safe: bool = False,
) -> DataFrame:
    """A new document per document: target paths (`$name`, `$address.city`) receive expression values.

    Fields without a mapping are dropped unless `pass_through`; with it, a nested target changes its own
    field and leaves its siblings, and a null record on the way becomes one. Targets lie below `root`. A
    text in place of an expression is the path of a value, such as `$address.city`: with `null_safe` a
    path below a null gives null, without it that is an error.
    """
    mapping = [(t, path_value(df, v, null_safe) if isinstance(v, str) else v) for t, v in mapping]
    prefix = root.removeprefix(ROOT).strip(".")
    tree: dict = {}
    for target, value in mapping:
        names = [n for n in [*prefix.split("."), *target.removeprefix(ROOT).split(".")] if n]
        place = tree
        for name in names[:-1]:
            place = place.setdefault(name, {})
            if not isinstance(place, dict):
                raise ValueError(f"target {target} lies below a mapped value")
        place[names[-1]] = value
    if pass_through:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        return df.withColumns({name: _merged(node, F.col(f"`{name}`"), kinds.get(name)) for name, node in tree.items()})
    return df.select(*[_merged(node, None, None).alias(name) for name, node in tree.items()])


def _merged(node, present: Column | None, kind: T.DataType | None) -> Column:
    """The value of a target; of a record that is there already, the fields without a mapping stay."""
    if not isinstance(node, dict):
        return node
    old = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    names = [*old, *[n for n in node if n not in old]]

    def field(name: str) -> Column:
        own = present.getField(name) if name in old else None
        return (_merged(node[name], own, old.get(name)) if name in node else own).alias(name)

    return F.struct(*[field(n) for n in names])


def path_value(df: DataFrame, path: str, null_safe: bool = False) -> Column:
    """The value at `$a.b.c`."""
    names = [n for n in path.removeprefix(ROOT).split(".") if n]
    value = F.col(f"`{names[0]}`")
    for name in names[1:]:
        if not null_safe:
            value = F.when(value.isNull(), F.raise_error(F.lit(f"{path} lies below a null"))).otherwise(value)
        value = value.getField(name)
    return value


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def select_all(df: DataFrame) -> DataFrame:
    return df.select("*")


def add_constant(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def add_expression(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, value)


def increment(df: DataFrame, source: str, target: str, by: int = 1, tolerant: bool = False) -> DataFrame:
    """`source + by`; overflow is an error, or null when tolerant."""
    total = F.try_add(F.col(source), F.lit(by)) if tolerant else F.col(source) + F.lit(by)
    return df.withColumn(target, total)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def cast_columns(df: DataFrame, types: Mapping[str, str], tolerant: bool = False) -> DataFrame:
    """Texts that do not fit the type are an error, or null when tolerant."""
    return df.withColumns({c: F.col(c).try_cast(t) if tolerant else F.col(c).cast(t) for c, t in types.items()})


def row_map(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Record-wise function written as one expression per field."""
    return df.select(*[value.alias(name) for name, value in fields.items()])


def flag(df: DataFrame, column: str, predicate: Column) -> DataFrame:
    """True where the predicate holds; false elsewhere, also on null."""
    return df.withColumn(column, F.when(predicate, F.lit(True)).otherwise(F.lit(False)))


def script(df: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A user's step over the whole frame."""
    return df.transform(function)


def script_batches(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """A user's step over record batches (pandas frames, through Arrow), for code that has no Column form."""
    return df.mapInPandas(function, schema)


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The output of each step is the input of the next."""
    for step in steps:
        df = df.transform(step)
    return df
