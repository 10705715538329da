"""Questions about the refresh log of the rollups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_back, elapsed_ms, moment
from ..functions.layout import top
from ..schemas import TABLES
from ..sources.tables import Tables
from .rollups import ROLLUPS

# Fixed value: a rollup is stale when more whole hours than this have gone by.
STALE_HOURS = 2


def folded(log: DataFrame) -> DataFrame:
    """One row per refresh: its end if it ended, else its start."""
    key = TABLES["mv_refresh_log"].key
    rest = [c for c in log.columns if c not in key]
    ended = F.struct(F.col("refresh_completed_at").isNotNull(), "refresh_completed_at")
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), ended).alias("r")).select(*key, "r.*").select(*log.columns)


def _duration() -> Column:
    return elapsed_ms("refresh_started_at", "refresh_completed_at")


def status(tables: Tables, as_of: datetime) -> DataFrame:
    """Per rollup: rows, last success, whole hours since, stale or not."""
    sizes = None
    for name in ROLLUPS:
        row = tables.rollup_size(name).select(F.lit(name).alias("view_name"), F.col("n").alias("row_count"))
        sizes = row if sizes is None else sizes.unionAll(row)
    last = (
        tables.read("mv_refresh_log")
        .filter(F.col("status") == "SUCCESS")
        .groupBy(F.col("mv_name").alias("view_name"))
        .agg(F.max("refresh_completed_at").alias("last_refresh"))
    )
    micros = F.unix_micros(moment(as_of)) - F.unix_micros("last_refresh")
    # Whole hours, cut towards zero.
    hours = (micros / F.lit(3_600_000_000)).cast("bigint")
    return (
        sizes.join(last, "view_name", "left")
        .withColumn("hours_since_refresh", hours)
        .withColumn("is_stale", F.col("hours_since_refresh") > STALE_HOURS)
        .orderBy("view_name")
    )


def history(tables: Tables, view: str | None = None, n: int = 50) -> DataFrame:
    """Newest refreshes with their duration, of all rollups or of one."""
    log = tables.read("mv_refresh_log")
    columns = ["refresh_started_at", "refresh_completed_at", "status", "rows_affected", "error_message"]
    if view is None:
        columns = ["mv_name", *columns]
    else:
        log = log.filter(F.col("mv_name") == view)
    return top(log.select(*columns, _duration().alias("duration_ms")), n, by="refresh_started_at")


def stats(tables: Tables, as_of: datetime, view: str, days: int = 7) -> DataFrame:
    log = tables.read("mv_refresh_log", after=days_back(as_of, days)).filter(F.col("mv_name") == view)
    return log.agg(
        F.count(F.lit(1)).alias("total_refreshes"),
        F.count_if(F.col("status") == "SUCCESS").alias("successful"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.avg(_duration()).alias("avg_duration_ms"),
    )


