"""The read side every report is written against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import first_day_after, moment, month_column
from ..operators import rollups
from ..schemas import TABLES


class Tables:
    """Named tables with time bounds that reach the scan.

    Subclasses implement ``load``; ``floor`` is a hint to skip data, the exact predicate is added here.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, name: str, floor: datetime | None = None) -> DataFrame:
        raise NotImplementedError

    def read(self, name: str, after: datetime | None = None, since: datetime | None = None) -> DataFrame:
        """Rows strictly later than ``after``, or at and later than ``since``; all rows by default."""
        df = self.load(name, floor=after or since)
        if after is None and since is None:
            return df
        time = TABLES[name].time
        if after is not None:
            df = df.filter(F.col(time) > moment(after))
        if since is not None:
            df = df.filter(F.col(time) >= moment(since))
        return df

    def newest(self, name: str, n: int, where: Column | None = None, until: datetime | None = None) -> DataFrame:
        """Rows that hold the newest ``n`` for which ``where`` holds (rows without a time count as newest), of those not later than ``until``. Here: all such rows."""
        rows = self.read(name)
        return rows if where is None else rows.filter(where)

    def size(self, name: str) -> DataFrame:
        """One row, ``n``: the number of rows."""
        return self.read(name).agg(F.count(F.lit(1)).alias("n"))

    def totals(self, name: str) -> DataFrame:
        """One row, ``n`` and ``total``: a fact's rows and the sum of what its rollup adds up last (null without any)."""
        spec = next(r for r in rollups.ROLLUPS.values() if r.fact == name and r.where is None)
        return self.summed(spec, self.read(name))

    def totals_by(self, name: str, column: str) -> DataFrame:
        """(column, n, total) of a fact by the values of a column its rollup keeps shares of."""
        spec = next(r for r in rollups.ROLLUPS.values() if r.fact == name and column in r.shares)
        return self.read(name).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sum(spec.shares[column]).alias("total"))

    @staticmethod
    def summed(spec: rollups.Rollup, facts: DataFrame) -> DataFrame:
        total = F.sum(spec.sums[spec.total]) if spec.total else F.lit(None)
        return facts.agg(F.count(F.lit(1)).alias("n"), total.cast("decimal(28,6)").alias("total"))

    def months(self, name: str) -> DataFrame:
        """(month): the months a table has dated rows of."""
        return self.read(name).select(month_column(TABLES[name].time).alias("month")).filter(F.col("month").isNotNull()).distinct()

    def rollup(self, name: str, after: datetime | None = None) -> DataFrame:
        """A daily rollup, days later than ``after``. Here: aggregated from the fact on the fly."""
        spec = rollups.ROLLUPS[name]
        since = first_day_after(after) if after is not None else None
        return spec.build(self.read(spec.fact, since=since) if since else self.facts_of(name))

    def facts_of(self, name: str) -> DataFrame:
        """The rows a whole rollup is built from, to be read several times."""
        return self.read(rollups.ROLLUPS[name].fact)

    def rollup_size(self, name: str) -> DataFrame:
        """One row, ``n``: the number of a rollup's rows. Here: of the days (and other keys) its fact has."""
        spec = rollups.ROLLUPS[name]
        return spec.size(self.read(spec.fact))
