"""Request export: validate queued requests, export them, report, and move the finished ones to the log."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.aggregates import conditional_count, count_column, count_nulls
from millrace.operators.joins import anti_join, semi_join
from millrace.operators.mapping import add_constant
from millrace.operators.routing import split_errors
from millrace.operators.sets import union
from millrace.operators.updates import mark_matched
from millrace.session import cut_lineage
from millrace.sinks.writers import append_run, csv_format, guard_non_empty, named_step, write_csv, write_error_report


@dataclass(frozen=True)
class RequestExport:
    """The frames of one run."""

    export_lines: DataFrame
    summary: DataFrame
    request_count: DataFrame
    error_count: DataFrame
    errors: DataFrame
    requests: DataFrame
    log: DataFrame
    queue: DataFrame


def request_export(
    queue: DataFrame,
    valid_ids: DataFrame,
    items: DataFrame,
    key: str,
    kind: str,
    kinds: Mapping[str, str],
    error: Column,
    detail: str,
    share: bool = False,
) -> RequestExport:
    """`queue` has `key` and `status`, `valid_ids` has `key`, `items` are the rows of each request.

    Requests with a valid id are exported with those of their items that have no `error`, become
    complete and go to the log; the others stay in the queue. `share` is for taking several of the
    outputs: what the joins of the queue and of the items give is then computed at once and written
    to the shared folder, where all outputs read it.
    """
    kept = cut_lineage if share else (lambda df: df)
    marked = kept(mark_matched(queue, valid_ids, [key], "_valid"))
    valid, left = (rows.drop("_valid") for rows in (marked.filter("_valid"), marked.filter("not _valid")))
    done = valid.withColumn("status", F.lit("complete"))
    good, bad = split_errors(kept(semi_join(items, valid.select(key), key)), error)
    return RequestExport(
        export_lines=csv_format(add_constant(good, "Status", "Fulfilled")),
        summary=conditional_count(good, [key], kind, kinds),
        request_count=count_column(valid, key, "RequestCount"),
        error_count=count_nulls(bad, detail, "ErrorCount"),
        errors=bad,
        requests=union(done, left),
        log=done,
        queue=left,
    )


def rejected(queue: DataFrame, valid_ids: DataFrame, key: str) -> DataFrame:
    return anti_join(queue, valid_ids, key)


def write_request_export(run: RequestExport, folder: str, name: str = "run") -> str | None:
    """Write the parts; an export without rows is a failure, one without errors has no error report. `name` tells runs
    apart: a job that is repeated under its name replaces its own rows of the log, which `writers.read_runs` reads."""
    with named_step("write export"):
        guard_non_empty(run.export_lines, "write export").write.mode("overwrite").text(f"{folder}/export")
    with named_step("write summary"):
        write_csv(run.summary, f"{folder}/summary")
    with named_step("move to log"):
        append_run(run.log, f"{folder}/log", name)
    with named_step("write error report"):
        return None if run.errors.isEmpty() else write_error_report(run.errors, folder)
