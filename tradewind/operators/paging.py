"""Pages of a sorted result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import how_many, newest_first, oldest_first


@dataclass(frozen=True)
class Page:
    """One page of rows, and a one-row count of all of them. Neither runs until used."""

    rows: DataFrame
    total: DataFrame


def page(df: DataFrame, by: str, number: int = 0, size: int = 50, ascending: bool = False) -> Page:
    """Page ``number`` (from 0) sorted on ``by``; ties go by the other columns."""
    rest = [c for c in df.columns if c != by]
    first = oldest_first(by) if ascending else newest_first(by)
    ordered = df.orderBy(*first, *oldest_first(*rest))
    skipped = ordered.offset(number * size) if number else ordered
    return Page(skipped.limit(size), how_many(df))


def behind(by: str, key: str, seen: tuple[object, object], ascending: bool = False) -> Column:
    """Rows that come after the one with these values of ``by`` and ``key`` in the order of ``page``."""
    last, last_key = seen
    tied = F.col(by).eqNullSafe(F.lit(last)) & (F.col(key) > F.lit(last_key))
    if last is None:  # missing values come first, or last when ascending
        return tied if ascending else tied | F.col(by).isNotNull()
    if ascending:
        return tied | (F.col(by) > F.lit(last)) | F.col(by).isNull()
    return tied | (F.col(by) < F.lit(last))


def next_page(df: DataFrame, by: str, key: str, seen: tuple[object, object] | None = None, size: int = 50, ascending: bool = False) -> Page:
    """The page behind the last row seen, by its ``by`` and ``key`` (one row each); the first without.

    Each task keeps ``size`` rows however deep the page, rows added meanwhile move nothing, and the bound on ``by`` reaches the scan.
    """
    rows = df
    if seen is not None:
        if seen[0] is not None and not ascending:
            rows = rows.filter(F.col(by) <= F.lit(seen[0]))  # as one comparison it is pushed down
        rows = rows.filter(behind(by, key, seen, ascending))
    first = oldest_first(by) if ascending else newest_first(by)
    return Page(rows.orderBy(*first, F.col(key)).limit(size), how_many(df))


def last_of(page: Page, by: str, key: str) -> tuple[object, object] | None:
    """What ``next_page`` goes on from; None behind the last page."""
    rows = page.rows.select(by, key).collect()  # a page
    return (rows[-1][by], rows[-1][key]) if rows else None
