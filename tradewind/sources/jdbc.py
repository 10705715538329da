"""Reporting tables kept in a relational database. Needs that database's JDBC driver on the class path."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES, conform
from .tables import Tables


class JdbcTables(Tables):
    """Reads each table in parallel slices of its time column or, lacking one, in one query."""

    def __init__(
        self,
        spark: SparkSession,
        url: str,
        oldest: datetime,
        newest: datetime,
        slices: int = 32,
        **properties: str,
    ):
        super().__init__(spark)
        self.url, self.oldest, self.newest, self.slices = url, oldest, newest, slices
        self.properties = properties

    def options(self, name: str, floor: datetime | None = None) -> dict[str, str]:
        options = {"url": self.url, "dbtable": name, **self.properties}
        time = TABLES[name].time
        if time is not None:
            options.update(
                partitionColumn=time,
                lowerBound=(floor or self.oldest).isoformat(sep=" "),
                upperBound=self.newest.isoformat(sep=" "),
                numPartitions=str(self.slices),
            )
        return options

    def load(self, name: str, floor: datetime | None = None) -> DataFrame:
        return conform(self.spark.read.format("jdbc").options(**self.options(name, floor)).load(), name)
