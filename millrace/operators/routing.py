"""Router, copy, error views and triage (RTE1-RTE4, SNK13)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace.functions.jsontext import is_pipeline_export
from millrace.sources.delimited import CORRUPT

Routes = Sequence[tuple[Column, str]]


def route(
    df: DataFrame, routes: Routes, first_match: bool = False, otherwise: str | None = None
) -> dict[str, DataFrame]:
    """Named outputs. A document goes to every route that matches, or with `first_match` to the first.

    Without `otherwise`, documents that match nothing (a null never matches) have no output;
    with it they have one more, so that the outputs reconcile with the input.
    """
    outputs = {}
    for position, (predicate, name) in enumerate(routes):
        earlier = [p for p, _ in routes[:position]] if first_match else []
        outputs[name] = df.filter(reduce(lambda kept, p: kept & ~_holds(p), earlier, predicate))
    if otherwise is not None:
        outputs[otherwise] = df.filter(~reduce(Column.__or__, [_holds(p) for p, _ in routes]))
    return outputs


def with_route(
    df: DataFrame, routes: Routes, first_match: bool = False, otherwise: str | None = None, column: str = "route"
) -> DataFrame:
    """The same outputs as one frame with the route's name in a column, from one pass over the input.

    To write them apart, partition the write by that column.
    """
    if first_match:
        label = reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(routes), F.lit(otherwise))
        return df.withColumn(column, label).filter(F.col(column).isNotNull())
    names = F.array_compact(F.array(*[F.when(p, F.lit(name)) for p, name in routes]))
    if otherwise is not None:
        names = F.when(F.size(names) == 0, F.array(F.lit(otherwise))).otherwise(names)
    return df.select("*", F.explode(names).alias(column))


def _holds(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def copy(df: DataFrame, outputs: int = 2, keep: bool = False) -> list[DataFrame]:
    """Every document to all outputs. `keep` stores the rows once when several sinks would recompute them."""
    if keep:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return [df] * outputs


def split_errors(df: DataFrame, error: Column | None = None, corrupt: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """(good, bad). By default a row is bad when the parser filled the corrupt-record column."""
    if error is None:
        is_bad = F.col(corrupt).isNotNull()
        return df.filter(~is_bad).drop(corrupt), df.filter(is_bad)
    return df.filter(~_holds(error)), df.filter(_holds(error))


def fail_on_errors(df: DataFrame, error: Column, message: str) -> DataFrame:
    """Policy `fail`: the first bad row stops the run."""
    passed = F.when(_holds(error), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.filter(passed)


def with_export_flag(files: DataFrame, text: str = "text", column: str = "is_export") -> DataFrame:
    """True for JSON objects that hold a pipeline layout; a null text (undecodable bytes) is junk."""
    _accept_repeated_keys(files)
    return files.withColumn(column, F.coalesce(is_pipeline_export(F.col(text)), F.lit(False)))


def triage(files: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pipeline exports, junk)."""
    flagged = with_export_flag(files, text, "_ok")
    return flagged.filter("_ok").drop("_ok"), flagged.filter("not _ok").drop("_ok")


def _accept_repeated_keys(df: DataFrame) -> None:
    # An object with a repeated key is valid JSON; the parser reads this when the plan is built.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
