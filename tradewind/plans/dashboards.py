"""Dashboard, user, activity, trade, issuance and time-series reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_back
from ..functions.layout import count_rows, how_many, newest_first, oldest_first, one_row, top
from ..sources.tables import Tables

# Fixed value: volume-by-currency and environmental-impact always look back this far.
LONG_WINDOW = 90


# -- overview and users


def overview_counts(tables: Tables) -> DataFrame:
    return one_row(
        tables.spark,
        {
            "total_users": how_many(tables.read("dim_users")),
            "total_trades": tables.totals("fact_trade").select("n"),
            "events_processed": tables.size("consumed_events"),
        },
    )


def users_by_role(tables: Tables) -> DataFrame:
    users = tables.read("dim_users").groupBy("role").agg(count_rows().alias("count"))
    return users.orderBy(F.desc("count"), "role")


def users_by_region(tables: Tables) -> DataFrame:
    """Grouped by the stored region: a missing one and a literal 'Unknown' stay two rows."""
    users = tables.read("dim_users").groupBy("region").agg(count_rows().alias("count"))
    shown = users.select(F.coalesce("region", F.lit("Unknown")).alias("region"), "count")
    return shown.orderBy(F.desc("count"), "region")


def recent_registrations(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    return tables.read("dim_users", after=days_back(as_of, days)).agg(
        count_rows().alias("recent_registrations")
    )


def trade_volume_by_currency(tables: Tables) -> DataFrame:
    """All time; one row per currency (callers wanting exactly one must check)."""
    return (
        tables.read("fact_trade")
        .groupBy("currency")
        .agg(F.sum("quantity").alias("total_quantity"), F.sum("amount").alias("total_amount"))
    )


def issuance_totals(tables: Tables) -> DataFrame:
    return tables.totals("fact_issuance").select(F.col("n").alias("total_issuances"), F.col("total").alias("total_tco2e"))


def recent_activities(tables: Tables, as_of: datetime, n: int = 10) -> DataFrame:
    """Newest activities of the last 24 hours with the user's name, if the user is known."""
    newest = top(
        tables.read("fact_user_activity", after=days_back(as_of, 1)).select(
            "event_type", "user_id", "occurred_at"
        ),
        n,
        by="occurred_at",
    )
    # A user has one row, so cutting to n before the join gives the same rows. Both sides below are at most n
    # rows, which Spark sees when they are there and joins accordingly.
    wanted = newest.select("user_id").distinct()
    names = tables.read("dim_users").select("user_id", "username").join(wanted, "user_id", "left_semi")
    named = newest.join(names, "user_id", "left")
    return named.select("event_type", "user_id", "username", "occurred_at").orderBy(
        *newest_first("occurred_at")
    )


# -- activity


def activity_by_type(tables: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    """``unique_users`` adds up daily distinct counts, so a user active on two days counts twice."""
    daily = tables.rollup("mv_user_activity_daily", after=days_back(as_of, days))
    return (
        daily.groupBy("event_type")
        .agg(F.sum("event_count").alias("count"), F.sum("unique_users").alias("unique_users"))
        .orderBy(*newest_first("count"), "event_type")
    )


def activity_timeline(tables: Tables, as_of: datetime, days: int = 7) -> DataFrame:
    daily = tables.rollup("mv_user_activity_daily", after=days_back(as_of, days))
    return daily.select(
        F.col("day").alias("date"), "event_type", F.col("event_count").alias("count"), "unique_users"
    ).orderBy(*newest_first("date"), *oldest_first("event_type"))


def top_active_users(tables: Tables, as_of: datetime, days: int = 7, n: int = 10) -> DataFrame:
    # Counting per user before the join leaves one row per user on both sides: a user with a third of
    # all activities is no heavier than any other.
    per_user = (
        tables.read("fact_user_activity", after=days_back(as_of, days)).groupBy("user_id").agg(count_rows().alias("n"))
    )
    named = per_user.join(tables.read("dim_users").select("user_id", "username", "role"), "user_id")
    counts = named.groupBy("username", "role").agg(F.sum("n").alias("activity_count"))
    return top(counts, n, by="activity_count")


# -- trades


def trades_total(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    return tables.read("fact_trade", after=days_back(as_of, days)).agg(count_rows().alias("total_trades"))


def trade_volume_by_currency_recent(tables: Tables, as_of: datetime) -> DataFrame:
    return (
        tables.read("fact_trade", after=days_back(as_of, LONG_WINDOW))
        .groupBy("currency")
        .agg(
            count_rows().alias("trade_count"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("amount").alias("total_amount"),
        )
    )


def recent_trades(tables: Tables, n: int = 10) -> DataFrame:
    trades = tables.newest("fact_trade", n).select(
        "order_id", "buyer_id", "seller_id", "quantity", "unit_price", "amount", "currency", "executed_at"
    )
    return top(trades, n, by="executed_at")


def trade_timeline(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    daily = tables.rollup("mv_trades_daily", after=days_back(as_of, days))
    return daily.select(
        F.col("day").alias("date"), "trade_count", F.col("revenue").alias("total_amount"), "avg_unit_price"
    ).orderBy(*newest_first("date"))


def buyer_seller_stats(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """Sums of daily distinct counts."""
    return tables.rollup("mv_trades_daily", after=days_back(as_of, days)).agg(
        F.sum("unique_buyers").alias("total_unique_buyers"),
        F.sum("unique_sellers").alias("total_unique_sellers"),
    )


# -- issuance


def issuance_window_totals(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    return tables.read("fact_issuance", after=days_back(as_of, days)).agg(
        count_rows().alias("total_issuances"), _or_zero("quantity_tco2e").alias("total_tco2e")
    )


def environmental_impact(tables: Tables, as_of: datetime) -> DataFrame:
    return tables.read("fact_issuance", after=days_back(as_of, LONG_WINDOW)).agg(
        _or_zero("distance_km").alias("total_distance"),
        _or_zero("energy_kwh").alias("total_energy"),
        _or_zero("co2_avoided_kg").alias("total_co2_avoided"),
    )


def recent_issuances(tables: Tables, n: int = 10) -> DataFrame:
    rows = tables.newest("fact_issuance", n).select(
        "issuance_id", "user_id", "quantity_tco2e", "distance_km", "energy_kwh", "co2_avoided_kg", "issued_at"
    )
    return top(rows, n, by="issued_at")


def issuance_timeline(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    daily = tables.rollup("mv_issuance_daily", after=days_back(as_of, days))
    return daily.select(
        F.col("day").alias("date"),
        F.col("issuance_count").alias("count"),
        F.col("credits_issued").alias("total_tco2e"),
        "avg_issuance",
    ).orderBy(*newest_first("date"))


def issuance_unique_users(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    return tables.rollup("mv_issuance_daily", after=days_back(as_of, days)).agg(
        F.sum("unique_users").alias("unique_users")
    )


# -- time series, oldest first


def user_registrations(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    recent = tables.read("dim_users", after=days_back(as_of, days))
    return recent.groupBy(F.to_date("created_at").alias("date")).agg(count_rows().alias("count")).orderBy("date")


def trade_volume_series(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    daily = tables.rollup("mv_trades_daily", after=days_back(as_of, days))
    return daily.select(
        F.col("day").alias("date"),
        F.col("trade_count").alias("trades"),
        F.col("revenue").alias("volume"),
        "credits_sold",
        "avg_unit_price",
        "unique_buyers",
        "unique_sellers",
    ).orderBy("date")


def issuance_series(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    daily = tables.rollup("mv_issuance_daily", after=days_back(as_of, days))
    return daily.select(
        F.col("day").alias("date"),
        F.col("issuance_count").alias("count"),
        F.col("credits_issued").alias("total_tco2e"),
        "avg_issuance",
        "unique_users",
    ).orderBy("date")


def event_processing_series(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    events = tables.read("consumed_events", after=days_back(as_of, days))
    return events.groupBy(F.to_date("received_at").alias("date")).agg(count_rows().alias("count")).orderBy("date")


def _or_zero(column: str):
    return F.coalesce(F.sum(column), F.lit(0))
