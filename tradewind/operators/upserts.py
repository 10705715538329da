"""Insert-or-update of facts, and the user fold.

Every fold is a grouped ``max_by`` / ``min_by``: one shuffle, map-side combine, no sorted group in one task.
Arrival order is fixed as (event time, event id); rows already stored come before any event.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import TABLES, Table, conform

# Which columns keep the value of the first row on a key conflict; all others take the last.
KEPT: dict[str, tuple[str, ...]] = {
    "fact_trade": (),
    "fact_payment": ("order_id", "amount", "currency", "payment_method"),
    "fact_issuance": ("request_id",),
}
# Columns saying when a row arrived.
ARRIVAL = ("arrived_at", "event_id")


def fold(rows: DataFrame, keys: Sequence[str], kept: Sequence[str], order: Column) -> DataFrame:
    """One row per key: ``kept`` columns from the first row by ``order``, the rest from the last."""
    replaced = [c for c in rows.columns if c not in keys and c not in kept and c not in ARRIVAL]
    parts = [F.max_by(F.struct(*replaced), order).alias("last")]
    if kept:
        parts.append(F.min_by(F.struct(*kept), order).alias("first"))
    folded = rows.groupBy(*keys).agg(*parts)
    return folded.select(*keys, "last.*", *(["first.*"] if kept else []))


def upsert(stored: DataFrame | None, arriving: DataFrame, table: Table | str) -> DataFrame:
    """``arriving`` (table columns + arrival columns) merged into ``stored`` (table columns, each key once).

    Only the arriving rows are folded. Stored rows meet the result in joins that Spark broadcasts it for while it is small, so they are
    neither shuffled nor sorted; beyond that both sides are shuffled by key.
    """
    table = TABLES[table] if isinstance(table, str) else table
    kept = KEPT.get(table.name, ())
    latest = conform(fold(arriving, table.key, kept, F.struct(*ARRIVAL)), table)
    if stored is None:
        return latest

    def same_key(left: str, right: str) -> Column:
        return reduce(and_, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in table.key))

    news = latest.withColumn("met", F.lit(True)).alias("n")
    both = stored.alias("s").join(news, same_key("s", "n"), "left")
    taken = (
        F.col(f"s.{c}") if c in table.key or c in kept else F.when(F.col("n.met"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")) for c in table.columns
    )
    updated = both.select(*(value.alias(c) for c, value in zip(table.columns, taken, strict=True)))
    # The keys stored already, cut to those arriving, are as few as these; only they are taken out.
    there = stored.select(*table.key).alias("s").join(latest.select(*table.key).alias("n"), same_key("s", "n"), "left_semi")
    return conform(updated, table).unionByName(latest.alias("n").join(there.alias("t"), same_key("n", "t"), "left_anti"))


# -- users

ACTIONS = ("REGISTERED", "LOGGED_IN", "UPDATED", "DELETED", "ENABLED", "DISABLED")
_PROFILE = ("username", "email", "role", "region", "organization_name", "phone_number")


_LATEST = (*_PROFILE, "enabled", "updated_at", "last_login_at")


def _dated(value: Column, sets: Column, at: Column, by: Column) -> Column:
    """A value with the time and id of the event that set it, null where none did."""
    return F.when(sets, F.struct(at.alias("at"), by.alias("by"), value.alias("value")))


def user_changes(events: DataFrame) -> DataFrame:
    """One row per user: for each column the last event that sets it, and the first registration. Such rows can be folded again."""
    action, at, by = F.col("action"), F.col("timestamp"), F.col("event_id")
    registers = action == "REGISTERED"
    enabled = (
        F.when(registers, F.coalesce("enabled", F.lit(True))).when(action == "DELETED", F.lit(False)).otherwise(F.col("enabled"))
    )
    set_by = {c: (F.col(c), registers | ((action == "UPDATED") & F.col(c).isNotNull())) for c in _PROFILE}
    set_by["enabled"] = (enabled, action.isin("REGISTERED", "DELETED", "ENABLED", "DISABLED"))
    set_by["created_at"] = (at, registers)
    set_by["updated_at"] = (at, F.lit(True))
    set_by["last_login_at"] = (at, action.isin("REGISTERED", "LOGGED_IN"))
    known = events.filter(action.isin(*ACTIONS))
    return fold_changes(known.select("user_id", *(_dated(v, sets, at, by).alias(c) for c, (v, sets) in set_by.items())))


def as_changes(stored: DataFrame) -> DataFrame:
    """Plain user rows as changes: each counts as a registration before all events."""
    at, by = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    columns = (*_LATEST, "created_at")
    return conform(stored.select("user_id", *(_dated(F.col(c), F.lit(True), at, by).alias(c) for c in columns)), "dim_user_changes")


def fold_changes(changes: DataFrame) -> DataFrame:
    """Changes of several batches, in any order, as one row per user."""
    folded = changes.groupBy("user_id").agg(*(F.max(c).alias(c) for c in _LATEST), F.min("created_at").alias("created_at"))
    return conform(folded, "dim_user_changes")


def users(changes: DataFrame) -> DataFrame:
    """Users as their changes (one row each) leave them. Only a registration creates a user."""
    known = changes.filter(F.col("created_at").isNotNull())
    return conform(known.select("user_id", *(F.col(f"{c}.value").alias(c) for c in (*_LATEST, "created_at"))), "dim_users")


def fold_users(stored: DataFrame, events: DataFrame) -> DataFrame:
    """User events applied to the stored users.

    For each column the last event that sets it wins. A stored row counts as a registration before
    all events. A registration sets every column, so whatever came before a user's first one is
    overwritten anyway, and users without any are dropped.
    """
    return users(fold_changes(as_changes(stored).unionByName(user_changes(events))))


def activities(events: DataFrame) -> DataFrame:
    """One activity row per recognised action."""
    known = events.filter(F.col("action").isin(*ACTIONS))
    return conform(
        known.select(
            "user_id",
            F.col("action").alias("event_type"),
            F.col("payload").alias("event_data"),
            F.col("timestamp").alias("occurred_at"),
        ),
        "fact_user_activity",
    )
