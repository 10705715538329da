"""Time arithmetic. Every report takes ``as_of`` (a naive UTC datetime) instead of reading the wall clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(at: datetime) -> Column:
    """A timestamp literal for a naive UTC datetime, whatever the zone of driver or session."""
    return F.lit(at.isoformat(sep=" ") + "Z").cast("timestamp")


def midnight(at: datetime) -> datetime:
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def days_back(as_of: datetime, days: int) -> datetime:
    return as_of - timedelta(days=days)


def first_day_after(at: datetime) -> datetime:
    """The first midnight strictly later than ``at``.

    ``day > at`` over midnight-truncated days keeps exactly the rows from here on, so this is the
    bound to hand to a scan.
    """
    return midnight(at) + timedelta(days=1)


def month_of(at: datetime) -> str:
    return at.strftime("%Y-%m")


def add_months(at: datetime, n: int) -> datetime:
    """First day of the month ``n`` months away."""
    index = at.year * 12 + at.month - 1 + n
    return datetime(index // 12, index % 12 + 1, 1)


def month_column(time_column: str) -> Column:
    return F.date_format(time_column, "yyyy-MM")


def day_of(time_column: str) -> Column:
    return F.date_trunc("day", time_column)


def elapsed_ms(start: str, end: str) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)
