"""Searches over system logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_back, moment
from ..functions.layout import how_many
from ..sources.tables import Tables
from .paging import Page, behind, next_page, page

# Fixed values.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
ERROR_LEVELS = ("ERROR", "FATAL")


def matching(
    tables: Tables,
    start: datetime,
    end: datetime,
    level: str | None = None,
    source: str | None = None,
    category: str | None = None,
    correlation_id: str | None = None,
) -> DataFrame:
    """Rows in the closed time range that meet every given condition."""
    rows = tables.read("system_logs", since=start).filter(F.col("log_timestamp") <= moment(end))
    wanted = {
        "log_level": level,
        "source_service": source,
        "category": category,
        "correlation_id": correlation_id,
    }
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def search(
    tables: Tables,
    as_of: datetime,
    start: datetime | None = None,
    end: datetime | None = None,
    number: int = 0,
    size: int = 50,
    **conditions: str | None,
) -> Page:
    """Newest first; the last 7 days unless told otherwise."""
    rows = matching(tables, start or days_back(as_of, 7), end or as_of, **conditions)
    return page(rows, "log_timestamp", number, size)


def search_on(
    tables: Tables,
    as_of: datetime,
    seen: tuple[object, object] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    size: int = 50,
    **conditions: str | None,
) -> Page:
    """As ``search``, from behind the last row seen (its time and id)."""
    rows = matching(tables, start or days_back(as_of, 7), end or as_of, **conditions)
    return next_page(rows, "log_timestamp", "id", seen, size)


def errors(tables: Tables, number: int = 0, size: int = 50) -> Page:
    return _newest_page(tables, F.col("log_level").isin(*ERROR_LEVELS), number, size)


def _newest_page(tables: Tables, where: Column, number: int, size: int) -> Page:
    """A page of all time, newest first, from as many months as it takes; only the total looks at all of them."""
    rows = tables.newest("system_logs", (number + 1) * size, where)
    return Page(page(rows, "log_timestamp", number, size).rows, how_many(tables.read("system_logs").filter(where)))


def errors_on(tables: Tables, seen: tuple[object, object] | None = None, size: int = 50) -> Page:
    """As ``errors``, from behind the last row seen; later months are not looked at."""
    where = F.col("log_level").isin(*ERROR_LEVELS)
    until = seen[0] if seen else None
    found = where if seen is None else where & behind("log_timestamp", "id", seen)
    rows = tables.newest("system_logs", size, found, until=until)
    return Page(next_page(rows, "log_timestamp", "id", seen, size).rows, how_many(tables.read("system_logs").filter(where)))


def by_correlation(tables: Tables, as_of: datetime, correlation_id: str, number: int = 0, size: int = 50) -> Page:
    """One correlation id over 30 days, oldest first."""
    rows = matching(tables, days_back(as_of, 30), as_of, correlation_id=correlation_id)
    return page(rows, "log_timestamp", number, size, ascending=True)


def by_field(tables: Tables, column: str, value: str, number: int = 0, size: int = 50) -> Page:
    """Single-field finder, all time."""
    return _newest_page(tables, F.col(column) == value, number, size)


def level_counts(tables: Tables, as_of: datetime, since: datetime | None = None) -> DataFrame:
    """Rows per level later than ``since`` (24 hours back), zero where there are none."""
    rows = tables.read("system_logs", after=since or days_back(as_of, 1))
    return rows.agg(*(F.count_if(F.col("log_level") == level).alias(level.lower()) for level in LEVELS))
