"""Archive files by month, look up their request counts, and make a success or warning message for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import lookup
from millrace.operators.routing import with_route
from millrace.sinks.archive import archive_write
from millrace.sinks.outbox import Notice, Run, routed_notifications
from millrace.sinks.writers import named_step, with_retries

# Output names of the router.
SUCCESS, WARNING = "output0", "output1"
SUCCESS_NOTICE_SUBJECT = "Export completed"
WARNING_NOTICE_SUBJECT = "Export warning"


def with_request_count(files: DataFrame, requests: DataFrame, file_id: str = "FileId") -> DataFrame:
    """`RequestCount` of each file; null when the table does not list it."""
    counts = requests.select(file_id, F.col("requestCount").alias("RequestCount"))
    return lookup(files, counts, file_id)


def notices(facts: dict[str, Column]) -> dict[str, Notice]:
    return {
        SUCCESS: Notice(SUCCESS_NOTICE_SUBJECT, "The export completed.", facts),
        WARNING: Notice(WARNING_NOTICE_SUBJECT, "Nothing was exported because of validation errors.", {}),
    }


def messages(counted: DataFrame, texts: dict[str, Notice], run: Run) -> DataFrame:
    """Documents with requests give success messages, those without give warnings; a null count gives none."""
    count = F.col("RequestCount")
    routed = with_route(counted, [(count > 0, SUCCESS), (count <= 0, WARNING)])
    return routed_notifications(routed, "route", texts, run)


def archive_and_notify(
    files: DataFrame,
    requests: DataFrame,
    archive_folder: str,
    run: Run,
    facts: dict[str, Column],
    name: str = "file_name",
    modified: str = "modificationTime",
    file_id: str = "FileId",
    retries: int = 2,
    interval: float = 1.0,
) -> DataFrame:
    """Archives at once; returns the messages for the outbox."""
    with named_step("archive"):
        with_retries(
            lambda: archive_write(files.drop(file_id), archive_folder, name, [modified], run.at), retries, interval
        )
    listed = files.select(file_id, name)
    return messages(with_request_count(listed, requests, file_id), notices(facts), run)
