"""KPI snapshot, event health and data-quality reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_back, midnight, moment
from ..functions.layout import count_rows, how_many, newest_first, one_row, top
from ..sources.tables import Tables


# -- KPIs


def kpi_snapshot(tables: Tables, as_of: datetime) -> DataFrame:
    """The gauges. Volume and credits (in thousandths) are cut to whole numbers."""
    trades, issuances = tables.totals("fact_trade"), tables.totals("fact_issuance")
    total = F.coalesce("total", F.lit(0))
    return one_row(
        tables.spark,
        {
            "users": how_many(tables.read("dim_users")),
            "trades": trades.select("n"),
            "issuances": issuances.select("n"),
            "events": tables.size("consumed_events"),
            "today_activities": how_many(tables.read("fact_user_activity", after=midnight(as_of))),
            "trade_volume": trades.select(total.cast("bigint")),
            "carbon_credits_milli": issuances.select((total * 1000).cast("bigint")),
        },
    )


def kpi_summary(tables: Tables) -> DataFrame:
    """Core counts; the volume shown is that of the alphabetically first currency."""
    issuances, events = tables.totals("fact_issuance"), tables.size("consumed_events")
    by_currency = tables.totals_by("fact_trade", "currency")
    first = F.min(F.struct(F.col("currency").isNull().alias("missing"), "currency", "total")).alias("first")
    volume = by_currency.agg(first).select("first.*")
    rate = events.select(F.when(F.col("n") > 0, 100.0).otherwise(0.0))
    return one_row(
        tables.spark,
        {
            "users": how_many(tables.read("dim_users")),
            "activities": tables.totals("fact_user_activity").select("n"),
            "trades": tables.totals("fact_trade").select("n"),
            "issuances": issuances.select("n"),
            "events_processed": events,
            "event_success_rate": rate,
            "volume_currency": F.coalesce(volume.select("currency").scalar(), F.lit("VND")),
            "volume_total_amount": F.coalesce(volume.select("total").scalar(), F.lit(0)),
            "total_carbon_credits": issuances.select(F.coalesce("total", F.lit(0))),
        },
    )


# -- event health


def event_counts(tables: Tables, as_of: datetime) -> DataFrame:
    today = F.col("received_at") > moment(midnight(as_of))
    return tables.read("consumed_events").agg(
        count_rows().alias("total_events"), F.count_if(today).alias("events_today")
    )


def latest_event(tables: Tables) -> DataFrame:
    return top(tables.newest("consumed_events", 1).select("event_id", "received_at"), 1, by="received_at")


def events_per_hour(tables: Tables, as_of: datetime) -> DataFrame:
    events = tables.read("consumed_events", after=days_back(as_of, 1))
    return (
        events.groupBy(F.date_trunc("hour", "received_at").alias("hour"))
        .agg(count_rows().alias("count"))
        .orderBy(*newest_first("hour"))
    )


# -- data quality


def orphaned_activities(tables: Tables) -> DataFrame:
    """Activities whose user is unknown."""
    # One row per user before the join, so no user can make a partition heavy.
    per_user = tables.read("fact_user_activity").groupBy("user_id").agg(count_rows().alias("n"))
    unknown = per_user.join(tables.read("dim_users").select("user_id"), "user_id", "left_anti")
    return unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphaned_activities"))


def duplicate_events(tables: Tables, source: str = "consumed_events") -> DataFrame:
    """Rows beyond the first per event id, in the ledger or in raw deliveries."""
    return tables.read(source).agg((count_rows() - F.count_distinct("event_id")).alias("duplicate_events"))


def activity_coverage(tables: Tables) -> DataFrame:
    """Share of users with activities. Unknown users count as active, so it can pass 100."""
    return _with_coverage(
        one_row(
            tables.spark,
            {"users_with_activities": _active_users(tables), "total_users": how_many(tables.read("dim_users"))},
        )
    )


def quality_report(tables: Tables) -> DataFrame:
    facts = one_row(
        tables.spark,
        {
            "orphaned_activities": orphaned_activities(tables),
            "duplicate_events": duplicate_events(tables),
            "users_with_activities": _active_users(tables),
            "total_users": how_many(tables.read("dim_users")),
        },
    )
    clean = (F.col("orphaned_activities") == 0) & (F.col("duplicate_events") == 0)
    verdict = F.when(clean, "HEALTHY").otherwise("NEEDS_ATTENTION")
    return _with_coverage(facts).withColumn("overall_health", verdict)


def _active_users(tables: Tables) -> DataFrame:
    return tables.read("fact_user_activity").agg(F.count_distinct("user_id").alias("n"))


def _with_coverage(df: DataFrame) -> DataFrame:
    share: Column = F.col("users_with_activities") * F.lit(100.0) / F.col("total_users")
    return df.withColumn("activity_coverage", F.when(F.col("total_users") > 0, share).otherwise(F.lit(0.0)))
