"""A fact that is a join of large tables, put together once for whoever reads it several times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from ..schemas import conform
from .tables import Tables
from .warehouse import scratch_folder


class Kept(Tables):
    """The given columns of one fact, written to a scratch folder and read back from there; other columns get their defaults."""

    def __init__(self, tables: Tables, fact: str, columns: list[str]):
        super().__init__(tables.spark)
        self.fact, self.path = fact, f"{scratch_folder(tables.spark, 'kept')}/{fact}"
        rows = tables.read(fact).select(*columns)
        self.schema = rows.schema
        rows.write.option("compression", "zstd").parquet(self.path)

    def load(self, name: str, floor: datetime | None = None) -> DataFrame:
        if name != self.fact:
            raise KeyError(name)
        return conform(self.spark.read.schema(self.schema).parquet(self.path), name)
