"""Message rows for an outbox table (SNK9). Sending them is left to a mailer."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dates import message_stamp, month_stamp
from millrace.functions.text import joined, replaced

# What a mailer is told with each message.
MESSAGE_TYPE = "HTML text"
BATCH_SIZE = 100
RETRIES = 3


@dataclass(frozen=True)
class Notice:
    """Texts of one kind of message. `facts` are lines of (label, value), shown only where given."""

    subject: str
    opening: str
    facts: Mapping[str, Column]


@dataclass(frozen=True)
class Run:
    """What the messages of a run share; every entry is a value of the run or a column of the rows."""

    recipients: Column
    sender: Column
    executed_by: Column
    archive_folder: Column
    process: Column
    at: Column
    cc: Column | None = None
    bcc: Column | None = None
    #: Paths of files, parted by semicolons like recipients.
    attachments: Column | None = None


def sender_address(prefix: str, environment: Column, domain: str) -> Column:
    return joined(prefix, environment, f"@{domain}")


def recipient_list(recipients: Column) -> Column:
    """Semicolons become commas."""
    return replaced(recipients, ";", ",")


def message_body(notice: Notice, run: Run) -> Column:
    """HTML lines; a missing value shows as nothing."""
    facts = [piece for label, value in notice.facts.items() for piece in (f"{label}: ", value, "<br>")]
    folder = replaced(run.archive_folder, "/", "\\")
    return joined(
        f"<html><body>{notice.opening}<br>",
        *facts,
        "<p>Executed on: ",
        message_stamp(run.at),
        "</p><p>Executed by: ",
        run.executed_by,
        "</p><p>Archived files: ",
        folder,
        month_stamp(run.at),
        "</p><p>Process: ",
        run.process,
        "</p></body></html>",
        null_as="",
    )


def notification_rows(df: DataFrame, notice: Notice, run: Run) -> DataFrame:
    """One message per document; the document's own fields stay in front."""
    return _messages(df, F.lit(notice.subject), message_body(notice, run), run)


def _messages(df: DataFrame, subject: Column, body: Column, run: Run) -> DataFrame:
    def listed(value: Column | None) -> Column:
        return F.lit(None).cast("string") if value is None else recipient_list(value)

    return df.select(
        "*",
        run.sender.alias("sender"),
        recipient_list(run.recipients).alias("receiver"),
        listed(run.cc).alias("cc"),
        listed(run.bcc).alias("bcc"),
        listed(run.attachments).alias("attachments"),
        subject.alias("subject"),
        body.alias("body"),
        F.lit(MESSAGE_TYPE).alias("message_type"),
        F.lit(BATCH_SIZE).alias("batch_size"),
        F.lit(RETRIES).alias("retries"),
    )


def routed_notifications(df: DataFrame, route: str, notices: Mapping[str, Notice], run: Run) -> DataFrame:
    """One message per document, with the texts of its route; one pass for all routes."""

    def by_route(make) -> Column:
        return F.coalesce(*[F.when(F.col(route) == name, make(notice)) for name, notice in notices.items()])

    subject = by_route(lambda n: F.lit(n.subject))
    body = by_route(lambda n: message_body(n, run))
    return _messages(df, subject, body, run)


def with_content(messages: DataFrame) -> DataFrame:
    """Messages that have a sender; `content` is subject and body."""
    kept = messages.filter(F.col("sender").isNotNull())
    return kept.withColumn("content", F.concat(F.col("subject"), F.lit("\n"), F.col("body")))
