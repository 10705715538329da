"""Regional, comprehensive and performance reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_back, moment
from ..functions.layout import count_rows, how_many, newest_first, oldest_first, one_row, region_or_unknown, top
from ..operators import regional
from ..sources.tables import Tables


def co2_by_region(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    stats = regional.co2_stats(tables, as_of, days)
    sums = ("total_tco2e", "total_distance_km", "total_energy_kwh", "total_co2_avoided_kg", "issuance_count")
    by_region = stats.groupBy("region").agg(*(F.sum(c).alias(c) for c in sums))
    return by_region.orderBy(*newest_first("total_tco2e"), "region")


def co2_timeline(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    return (
        regional.co2_stats(tables, as_of, days)
        .select(
            "date",
            "region",
            "total_tco2e",
            F.col("issuance_count").alias("count"),
            "total_distance_km",
            "total_co2_avoided_kg",
        )
        .orderBy(*newest_first("date"), *oldest_first("region"))
    )


def revenue_by_region(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """``avg_trade_value`` is the plain mean of the daily means."""
    stats = regional.trade_stats(tables, as_of, days)
    daily_mean = F.col("total_amount") / F.nullif(F.col("trade_count"), F.lit(0))
    return (
        stats.groupBy("region", "currency")
        .agg(
            F.sum("total_amount").alias("total_revenue"),
            F.sum("total_quantity").alias("total_quantity"),
            F.sum("trade_count").alias("trade_count"),
            F.avg(daily_mean).alias("avg_trade_value"),
        )
        .orderBy(*newest_first("total_revenue"), "region")
    )


def revenue_timeline(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    return (
        regional.trade_stats(tables, as_of, days)
        .select(
            "date",
            "region",
            "currency",
            F.col("total_amount").alias("total_revenue"),
            "trade_count",
            "total_quantity",
        )
        .orderBy(*newest_first("date"), *oldest_first("region"))
    )


def transactions_by_region(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """A trade whose auction flag is missing counts as fixed price."""
    auction = F.coalesce("is_auction", F.lit(False))
    return (
        tables.read("fact_trade", after=days_back(as_of, days))
        .groupBy(region_or_unknown().alias("region"))
        .agg(
            count_rows().alias("transaction_count"),
            F.count_if(auction).alias("auction_count"),
            F.count_if(~auction).alias("fixed_count"),
        )
        .orderBy(F.desc("transaction_count"), "region")
    )


def users_by_region_and_role(tables: Tables) -> DataFrame:
    return regional.user_stats(tables).orderBy("region", F.desc("user_count"), "role")


def users_summary(tables: Tables) -> DataFrame:
    users = regional.user_stats(tables).groupBy("region").agg(F.sum("user_count").alias("total_users"))
    return users.orderBy(F.desc("total_users"), "region")


# -- comprehensive report


def co2_metrics(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """``total_issuances`` is the number of days with issuances, ``unique_contributors`` a sum over days."""
    after = days_back(as_of, days)
    daily = tables.rollup("mv_issuance_daily", after=after)
    facts = tables.read("fact_issuance", after=after)

    def total(df: DataFrame, column: str) -> DataFrame:
        return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("v"))

    return one_row(
        tables.spark,
        {
            "total_tco2e": total(daily, "credits_issued"),
            "total_issuances": how_many(daily),
            "unique_contributors": total(daily, "unique_users"),
            "total_distance_km": total(facts, "distance_km"),
            "total_co2_avoided_kg": total(facts, "co2_avoided_kg"),
            "total_energy_kwh": total(facts, "energy_kwh"),
        },
    )


def revenue_metrics(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    return tables.rollup("mv_trades_daily", after=days_back(as_of, days)).agg(
        F.lit("VND").alias("currency"),
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("total_revenue"),
        F.coalesce(F.avg("avg_unit_price"), F.lit(0)).alias("avg_price"),
        F.sum("trade_count").alias("trade_count"),
        F.sum("credits_sold").alias("total_credits_sold"),
        F.sum("unique_buyers").alias("unique_buyers"),
        F.sum("unique_sellers").alias("unique_sellers"),
    )


def transaction_metrics(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """Here the distinct counts are true ones."""
    return tables.read("fact_trade", after=days_back(as_of, days)).agg(
        count_rows().alias("total_trades"),
        F.count("listing_id").alias("marketplace_trades"),
        F.count_distinct("buyer_id").alias("unique_buyers"),
        F.count_distinct("seller_id").alias("unique_sellers"),
    )


def user_metrics(tables: Tables) -> DataFrame:
    """Users per role and in total; the total is the row marked ``is_total``, and there without users too."""
    per_role = tables.read("dim_users").groupBy("role").agg(count_rows().alias("count"))
    return with_total(per_role, "role", "count").orderBy(F.desc("is_total"), F.desc("count"), "role")


def regional_breakdown(tables: Tables, as_of: datetime, days: int = 30) -> DataFrame:
    """Trades beside issuances per region. A region-day with trades in two currencies meets its
    issuance row twice, and that row's sums count twice."""
    t = regional.trade_stats(tables, as_of, days).alias("t")
    c = regional.co2_stats(tables, as_of, days).alias("c")
    same_region_day = (F.col("t.region") == F.col("c.region")) & (F.col("t.date") == F.col("c.date"))
    return (
        t.join(c, same_region_day, "full_outer")
        .groupBy(F.coalesce("t.region", "c.region").alias("region"))
        .agg(
            F.sum("t.trade_count").alias("trades"),
            F.sum("t.total_amount").alias("revenue"),
            F.sum("c.issuance_count").alias("issuances"),
            F.sum("c.total_tco2e").alias("tco2e"),
        )
        .orderBy(F.desc_nulls_last("revenue"), "region")
    )


# -- performance report


def event_metrics(tables: Tables, as_of: datetime) -> DataFrame:
    """Ledger events per type, with the share of the last 24 hours; the total row is marked, and there without events too."""
    recent = F.col("received_at") > moment(days_back(as_of, 1))
    per_type = (
        tables.read("consumed_events")
        .groupBy("event_type")
        .agg(count_rows().alias("count"), F.count_if(recent).alias("count_24h"))
    )
    return with_total(per_type, "event_type", "count", "count_24h").orderBy(F.desc("is_total"), F.desc("count"), "event_type")


def with_total(per_kind: DataFrame, kind: str, *counts: str) -> DataFrame:
    """Rows per kind and one marked row with their sums, which is there (as 0) even if no kind is."""
    total = per_kind.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
    one = total.select(F.lit(None).cast("string").alias(kind), *counts, F.lit(True).alias("is_total"))
    return per_kind.select(kind, *counts, F.lit(False).alias("is_total")).unionAll(one)


def activity_metrics(tables: Tables, as_of: datetime) -> DataFrame:
    """Total and 24-hour activity counts beside the ten commonest types of the last 7 days; without any, one row
    with the counts alone."""
    recent = F.count_if(F.col("occurred_at") > moment(days_back(as_of, 1)))
    totals = tables.read("fact_user_activity").agg(count_rows().alias("total_activities"), recent.alias("activities_24h"))
    week = tables.read("fact_user_activity", after=days_back(as_of, 7))
    by_type = top(week.groupBy("event_type").agg(count_rows().alias("count")), 10, by="count")
    # At most ten of them, as one cell beside the totals.
    types = by_type.agg(F.collect_list(F.struct("event_type", "count")).alias("types"))
    return (
        totals.withColumn("types", types.scalar())
        .select(F.explode_outer("types").alias("t"), "total_activities", "activities_24h")
        .select("t.event_type", "t.count", "total_activities", "activities_24h")
        .orderBy(F.desc("count"), "event_type")
    )
