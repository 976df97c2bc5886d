"""Stamps (SC8, SC9). The instant is an argument, so that a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month folder pattern; date-time pattern and zone of messages (a fixed -05:00).
MONTH_PATTERN = "yyyyMM"
STAMP_PATTERN = "yyyy-MM-dd hh:mm:ss a"
STAMP_ZONE = "EST"


def month_stamp(at: Column | None = None) -> Column:
    """The month of an instant in the session's zone (`session.SETTINGS` sets it to UTC)."""
    return F.date_format(F.current_timestamp() if at is None else at, MONTH_PATTERN)


def message_stamp(at: Column | None = None, zone: str = STAMP_ZONE) -> Column:
    """The instant in the zone of messages, whatever the session's zone is."""
    instant = F.current_timestamp() if at is None else at
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))
    return F.date_format(local, STAMP_PATTERN)
