"""Result layout: orderings, one-row results, display defaults."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def region_or_unknown(column: str = "region") -> Column:
    return F.coalesce(F.col(column), F.lit("Unknown"))


def newest_first(*columns: str) -> list[Column]:
    """Descending with nulls first, the order the reports promise."""
    return [F.desc_nulls_first(c) for c in columns]


def oldest_first(*columns: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def top(df: DataFrame, n: int, by: str, offset: int = 0) -> DataFrame:
    """Newest ``n`` rows. Ties go by the other columns, so tied rows are equal rows.

    Plans as TakeOrderedAndProject: each task keeps its own best rows, nothing is fully sorted.
    """
    rest = [c for c in df.columns if c != by]
    ordered = df.orderBy(*newest_first(by), *oldest_first(*rest))
    return (ordered.offset(offset) if offset else ordered).limit(n)


def one_row(spark: SparkSession, cells: Mapping[str, DataFrame | Column]) -> DataFrame:
    """One row whose cells are scalar subqueries (one-row, one-column frames) or plain columns.

    Scalar subqueries run side by side, and Catalyst merges those that scan the same table.
    """
    return spark.range(1).select(
        *(
            (cell.scalar() if isinstance(cell, DataFrame) else cell).alias(name)
            for name, cell in cells.items()
        )
    )


def count_rows() -> Column:
    return F.count(F.lit(1))


def how_many(df: DataFrame) -> DataFrame:
    return df.agg(count_rows().alias("n"))
