"""Searches over notifications, and marking them read. A row without target user is a broadcast."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import days_back
from ..sources.tables import Tables
from .paging import Page, page


def _broadcast() -> Column:
    return F.col("target_user_id").isNull()


def for_user(tables: Tables, user_id: str, unread_only: bool = False, number: int = 0, size: int = 20) -> Page:
    """The user's own and the broadcast rows, newest first; expired rows stay in until purged."""
    rows = tables.read("system_notifications").filter((F.col("target_user_id") == user_id) | _broadcast())
    if unread_only:
        rows = rows.filter(~F.col("read_status"))
    return page(rows, "created_at", number, size)


def by_level(tables: Tables, level: str, number: int = 0, size: int = 20) -> Page:
    rows = tables.read("system_notifications").filter(F.col("level") == level)
    return page(rows, "created_at", number, size)


def by_category(tables: Tables, category: str, number: int = 0, size: int = 20) -> Page:
    rows = tables.read("system_notifications").filter(F.col("category") == category)
    return page(rows, "created_at", number, size)


def by_id(tables: Tables, notification_id: str) -> DataFrame:
    return tables.read("system_notifications").filter(F.col("notification_id") == notification_id)


def by_target(tables: Tables, user_id: str | None, read: bool, number: int = 0, size: int = 20) -> Page:
    """Rows of one user, or the broadcasts when ``user_id`` is None, in one read state."""
    target = _broadcast() if user_id is None else F.col("target_user_id") == user_id
    rows = tables.read("system_notifications").filter(target & (F.col("read_status") == F.lit(read)))
    return page(rows, "created_at", number, size)


def unread_count(tables: Tables, user_id: str) -> DataFrame:
    mine = (F.col("target_user_id") == user_id) | _broadcast()
    return tables.read("system_notifications").filter(mine).agg(
        F.count_if(~F.col("read_status")).alias("unread")
    )


def unread_counts(tables: Tables) -> DataFrame:
    """Unread rows of every user at once: own ones by join, broadcasts as one number for all."""
    unread = tables.read("system_notifications").filter(~F.col("read_status"))
    to_all = unread.filter(_broadcast()).agg(F.count(F.lit(1)).alias("n"))
    own = (
        unread.filter(~_broadcast())
        .groupBy(F.col("target_user_id").alias("target"))
        .agg(F.count(F.lit(1)).alias("own"))
    )
    users = tables.read("dim_users").select("user_id")
    return (
        users.join(own, F.col("user_id").cast("string") == F.col("target"), "left")
        .withColumn("to_all", to_all.scalar())
        .select("user_id", (F.coalesce("own", F.lit(0)) + F.col("to_all")).alias("unread"))
    )


def counts_by_level(tables: Tables, as_of: datetime, since: datetime | None = None) -> DataFrame:
    rows = tables.read("system_notifications", after=since or days_back(as_of, 7))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("count"))


def apply_reads(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """Mark rows read from receipts (``notification_id``, ``user_id``, ``read_at``).

    A receipt with a notification id marks that row; one with only a user id marks all rows the user
    sees, broadcasts included. Rows already read keep their time. The earliest receipt counts.
    """
    first = F.min("read_at")
    by_row = (
        reads.filter(F.col("notification_id").isNotNull())
        .groupBy(F.col("notification_id").alias("receipt_id"))
        .agg(first.alias("row_read"))
    )
    everything = reads.filter(F.col("notification_id").isNull() & F.col("user_id").isNotNull())
    by_user = everything.groupBy(F.col("user_id").alias("reader")).agg(first.alias("user_read"))
    by_anyone = everything.agg(first.alias("t"))

    columns = notifications.columns
    # Only unread rows are looked up, and broadcasts (null target) never enter the join by user.
    unread = notifications.filter(~F.col("read_status"))
    own = unread.filter(~_broadcast()).join(by_user, F.col("target_user_id") == F.col("reader"), "left")
    shared = unread.filter(_broadcast()).withColumn("user_read", by_anyone.scalar())
    met = own.select(*columns, "user_read").unionByName(shared.select(*columns, "user_read"))
    read_at = F.least("row_read", "user_read")
    marked = met.join(by_row, F.col("notification_id") == F.col("receipt_id"), "left").withColumns(
        {"read_status": read_at.isNotNull(), "read_at": F.coalesce(read_at, F.col("read_at"))}
    )
    return marked.select(*columns).unionByName(notifications.filter(F.col("read_status")))


def with_receipts(notifications: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rows beside which receipts (``notification_id``, ``read_at``) are kept, as read as these say. Only unread rows are looked up."""
    first = receipts.groupBy(F.col("notification_id").alias("receipt_id")).agg(F.min("read_at").alias("row_read"))
    columns = notifications.columns
    unread = notifications.filter(~F.col("read_status")).join(first, F.col("notification_id") == F.col("receipt_id"), "left")
    marked = unread.withColumns({"read_status": F.col("row_read").isNotNull(), "read_at": F.coalesce("row_read", "read_at")})
    return marked.select(*columns).unionByName(notifications.filter(F.col("read_status")))


def receipts(unread: DataFrame, reads: DataFrame) -> DataFrame:
    """The receipts of single rows that ``reads`` come to: those with an id as they are, and one for each unread row a user's receipt for all marks."""
    single = reads.filter(F.col("notification_id").isNotNull()).select("notification_id", "read_at")
    everything = reads.filter(F.col("notification_id").isNull())
    marked = apply_reads(unread, everything).filter("read_status")
    return single.unionByName(marked.select("notification_id", "read_at"))
