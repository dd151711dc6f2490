from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the last millisecond of year 9999.
_LAST_MS = 253_402_300_799_999


def epoch_ms_to_ts(ms: Column) -> Column:
    """Null where the number is no time that can be stored, so one bad event does not
    fail the job."""
    return F.when(ms.between(-_LAST_MS, _LAST_MS), F.timestamp_millis(ms))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def start_of_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def partition_day(ts: Column) -> Column:
    return F.to_date(ts)


def trunc_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    amount = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_millis(F.unix_millis(ts) + amount.cast("long") * 1000)


# The shift is on the side of `now`, a constant, so that the conditions can be pushed
# down to the files.


def age_expired(ts: Column, ttl_s: int, now: Column) -> Column:
    """The row is older than its time to live."""
    return ts < plus_seconds(now, -ttl_s)


def idle_expired(last_active: Column, timeout_s: int, now: Column) -> Column:
    """Idle strictly longer than the timeout: the next event opens a new session."""
    return last_active < plus_seconds(now, -timeout_s)


def sweep_due(last_active: Column, timeout_s: int, now: Column) -> Column:
    """Idle for the timeout or longer: the sweep may finalize the session."""
    return last_active <= plus_seconds(now, -timeout_s)
