"""Regional day aggregates. A missing region is shown, and grouped, as 'Unknown'."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import day_of, days_back, first_day_after, midnight
from ..functions.layout import region_or_unknown
from ..sources.tables import Tables

# Fixed value: the views never look back further than this.
VIEW_DAYS = 90


def _floor(as_of: datetime, days: int | None) -> datetime:
    """Oldest timestamp a report over the last ``days`` days can need from a 90-day view."""
    oldest = days_back(midnight(as_of), VIEW_DAYS)
    return oldest if days is None else max(oldest, first_day_after(days_back(as_of, days)))


def co2_stats(tables: Tables, as_of: datetime, days: int | None = None) -> DataFrame:
    """Region x day. With ``days``, only dates later than ``as_of - days``."""
    rows = tables.read("fact_issuance", since=_floor(as_of, days))
    return rows.groupBy(region_or_unknown().alias("region"), day_of("issued_at").alias("date")).agg(
        F.count(F.lit(1)).alias("issuance_count"),
        F.sum("quantity_tco2e").alias("total_tco2e"),
        F.sum("distance_km").alias("total_distance_km"),
        F.sum("energy_kwh").alias("total_energy_kwh"),
        F.sum("co2_avoided_kg").alias("total_co2_avoided_kg"),
    )


def trade_stats(tables: Tables, as_of: datetime, days: int | None = None) -> DataFrame:
    """Region x currency x day."""
    rows = tables.read("fact_trade", since=_floor(as_of, days))
    return rows.groupBy(
        region_or_unknown().alias("region"), "currency", day_of("executed_at").alias("date")
    ).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("amount").alias("total_amount"),
    )


def user_stats(tables: Tables) -> DataFrame:
    """Region x role."""
    users = tables.read("dim_users")
    return users.groupBy(region_or_unknown().alias("region"), "role").agg(
        F.count(F.lit(1)).alias("user_count")
    )


def register_views(tables: Tables, as_of: datetime) -> list[str]:
    """The three aggregates as temp views, for people who query with SQL."""
    views = {
        "v_regional_co2_stats": co2_stats(tables, as_of),
        "v_regional_trade_stats": trade_stats(tables, as_of),
        "v_regional_user_stats": user_stats(tables),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
