"""Time helpers.  All event times are TIMESTAMP_NTZ, so no result depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The open ends of time as they may arrive from outside.  Inside the
# tables they are never stored: "no watermark yet" is NULL, "at the end" is done = true.
EPOCH = "1970-01-01 00:00:00"
END_OF_TIME = "9999-12-31 23:59:59.999999"

# Seconds that an interval is cut to: about 30,000 years, longer than the calendar.
LONGEST_SECONDS = 999_999_999_999


def ntz(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def interval(seconds: float) -> Column:
    """A day-time interval literal with micro-second precision; infinity is cut to the longest one."""
    seconds = max(-LONGEST_SECONDS, min(seconds, LONGEST_SECONDS))
    return F.expr(f"make_dt_interval(0, 0, 0, cast({seconds:.6f} as decimal(18, 6)))")


def days(n: int) -> Column:
    return F.expr(f"make_dt_interval({int(n)})")


def discovery_time(event_ts: Column, poll_ts: Column) -> Column:
    """An output's own time if it has one, else the time of the poll that listed it."""
    return F.coalesce(event_ts, poll_ts)


def event_time(event_ts: Column) -> Column:
    """A record's own time, or the epoch when its source assigns none."""
    return F.coalesce(event_ts, ntz(EPOCH))
