"""Cases the given tables do not hold."""

from datetime import datetime, timedelta

from tests.helpers import AS_OF, dicts
from tradewind.functions.clock import add_months, days_back, first_day_after
from tradewind.operators import dedup, logs, notifications, regional
from tradewind.plans import dashboards, health, regions
from tradewind.schemas import conform
from tradewind.sources.jdbc import JdbcTables


def trade(i, at, **fields):
    base = {"order_id": i, "buyer_id": 1, "seller_id": 2, "quantity": 1, "unit_price": 1, "amount": 10, "executed_at": at}
    return {**base, **fields}


def test_two_currencies_count_issuances_twice(memory):
    at = "2024-01-20 10:00:00"
    tables = memory(
        fact_trade=[trade("a", at, region="N"), trade("b", at, region="N", currency="USD")],
        fact_issuance=[
            {"issuance_id": "i", "user_id": 1, "quantity_tco2e": 4, "issued_at": at, "region": "N"},
            {"issuance_id": "j", "user_id": 1, "quantity_tco2e": 1, "issued_at": at, "region": "S"},
        ],
    )
    result = [(r["region"], r["trades"], r["issuances"], r["tco2e"]) for r in dicts(regions.regional_breakdown(tables, AS_OF))]
    assert [(a, b, c, None if d is None else int(d)) for a, b, c, d in result] == [("N", 2, 2, 8), ("S", None, 1, 1)]


def test_windows_are_strict_and_open_at_the_end(memory):
    edge = days_back(AS_OF, 30)
    tables = memory(
        fact_trade=[
            trade("edge", edge),
            trade("in", edge + timedelta(seconds=1)),
            trade("later", AS_OF + timedelta(days=3)),
        ]
    )
    assert dicts(dashboards.trades_total(tables, AS_OF)) == [{"total_trades": 2}]
    days = [str(r["date"])[:10] for r in dicts(dashboards.trade_timeline(tables, AS_OF))]
    assert days == ["2024-02-02"]  # the first, partial day is not in a rollup window
    assert first_day_after(edge) == datetime(2024, 1, 1)


def test_views_stop_at_ninety_days(memory):
    tables = memory(
        fact_trade=[trade("a", "2023-11-01 00:00:00"), trade("b", "2023-10-31 23:59:59"), trade("c", "2023-11-02 00:00:00")]
    )
    assert regional.trade_stats(tables, AS_OF).count() == 2
    assert regional.trade_stats(tables, AS_OF, days=365).count() == 2
    assert regional.trade_stats(tables, AS_OF, days=30).count() == 0


def test_unknown_region_by_raw_column(memory):
    users = [{"user_id": i, "role": "R", "region": r} for i, r in enumerate((None, "Unknown", None))]
    tables = memory(dim_users=users)
    assert sorted(r["count"] for r in dicts(dashboards.users_by_region(tables))) == [1, 2]
    assert [r["total_users"] for r in dicts(regions.users_summary(tables))] == [3]


def test_reports_on_empty_tables(memory):
    empty = memory()
    (kpi,) = dicts(health.kpi_summary(empty))
    assert (kpi["event_success_rate"], kpi["volume_currency"], int(kpi["volume_total_amount"])) == (0.0, "VND", 0)
    (quality,) = dicts(health.quality_report(empty))
    assert (quality["overall_health"], quality["activity_coverage"]) == ("HEALTHY", 0.0)
    (revenue,) = dicts(regions.revenue_metrics(empty, AS_OF))
    assert (int(revenue["total_revenue"]), revenue["trade_count"]) == (0, None)
    (snapshot,) = dicts(health.kpi_snapshot(empty, AS_OF))
    assert snapshot["trade_volume"] == 0 and snapshot["users"] == 0


def test_recent_activities_keep_unknown_users(memory):
    tables = memory(
        fact_user_activity=[
            {"user_id": u, "event_type": "X", "occurred_at": AS_OF - timedelta(minutes=u)} for u in range(1, 15)
        ],
        dim_users=[{"user_id": 2, "username": "bo", "role": "R"}],
    )
    rows = dicts(dashboards.recent_activities(tables, AS_OF))
    assert [(r["user_id"], r["username"]) for r in rows] == [(u, "bo" if u == 2 else None) for u in range(1, 11)]


def test_orphans_and_coverage(memory):
    tables = memory(
        fact_user_activity=[{"user_id": u, "event_type": "X", "occurred_at": AS_OF} for u in (1, 1, 2, 3, 3, 3)],
        dim_users=[{"user_id": 1, "role": "R"}],
    )
    (row,) = dicts(health.quality_report(tables))
    assert (row["orphaned_activities"], row["activity_coverage"]) == (4, 300.0)


NOTES = [
    {"notification_id": "mine", "target_user_id": "7", "level": "INFO", "category": "A", "title": "t"},
    {"notification_id": "other", "target_user_id": "8", "level": "INFO", "category": "A", "title": "t"},
    {"notification_id": "all", "level": "INFO", "category": "A", "title": "t"},
    {"notification_id": "read", "target_user_id": "7", "read_status": True, "read_at": "2024-01-01 00:00:00"},
]


def read(spark, memory, *receipts):
    reads = spark.createDataFrame(list(receipts), "notification_id string, user_id string, at string").selectExpr(
        "notification_id", "user_id", "cast(at as timestamp) read_at"
    )
    rows = dicts(notifications.apply_reads(memory(system_notifications=NOTES).read("system_notifications"), reads))
    return {r["notification_id"]: str(r["read_at"]) if r["read_status"] else None for r in rows}


def test_mark_one_read(spark, memory):
    at = "2024-01-05 00:00:00"
    assert read(spark, memory, ("mine", None, at), ("read", None, at), ("nobody", None, at)) == {
        "mine": at,
        "other": None,
        "all": None,
        "read": "2024-01-01 00:00:00",
    }


def test_mark_all_of_a_user_takes_broadcasts(spark, memory):
    early, late = "2024-01-05 00:00:00", "2024-01-06 00:00:00"
    assert read(spark, memory, (None, "7", late), ("mine", None, early)) == {
        "mine": early,
        "other": None,
        "all": late,
        "read": "2024-01-01 00:00:00",
    }


def test_unread_counts(memory):
    tables = memory(system_notifications=NOTES, dim_users=[{"user_id": u, "role": "R"} for u in (7, 9)])
    counts = {r["user_id"]: r["unread"] for r in dicts(notifications.unread_counts(tables))}
    assert counts == {7: 2, 9: 1}
    assert dicts(notifications.unread_count(tables, "7")) == [{"unread": 2}]
    assert notifications.by_id(tables, "all").count() == 1


def test_log_search(memory):
    rows = [
        {"id": str(h), "log_level": "ERROR" if h % 2 else "INFO", "source_service": "s", "log_timestamp": AS_OF - timedelta(hours=h)}
        for h in range(0, 200, 3)
    ]
    tables = memory(system_logs=rows)
    week = logs.search(tables, AS_OF)
    assert dicts(week.total) == [{"n": 57}]  # both ends of the seven days included
    assert [r["id"] for r in dicts(logs.search(tables, AS_OF, level="ERROR", number=1, size=2).rows)] == ["15", "21"]
    (counts,) = dicts(logs.level_counts(tables, AS_OF))
    assert counts == {"debug": 0, "info": 4, "warn": 0, "error": 4, "fatal": 0}


def test_first_delivery_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "id string, n int, v string")
    ledger = spark.createDataFrame([("b",), ("c",)], "id string")
    assert dicts(dedup.new_rows(df, ledger, "id", df["n"])) == [{"id": "a", "n": 1, "v": "y"}]


def test_conform_first_layout(spark):
    old = spark.createDataFrame([("5", "R", "acme")], "user_id string, role string, org string")
    (row,) = dicts(conform(old, "dim_users"))
    assert (row["user_id"], row["organization_name"], row["enabled"], row["region"]) == (5, "acme", True, None)
    given_null = spark.createDataFrame([("p", None)], "payment_id string, currency string")
    assert dicts(conform(given_null, "fact_payment"), "currency") == [{"currency": None}]


def test_months():
    assert add_months(AS_OF, -24) == datetime(2022, 1, 1)
    assert add_months(AS_OF, 12) == datetime(2025, 1, 1)


def test_jdbc_reads_in_slices_of_time(spark):
    tables = JdbcTables(spark, "jdbc:x", datetime(2020, 1, 1), AS_OF, user="u")
    options = tables.options("fact_trade", floor=datetime(2024, 1, 1))
    assert (options["partitionColumn"], options["lowerBound"], options["numPartitions"]) == (
        "executed_at",
        "2024-01-01 00:00:00",
        "32",
    )
    assert "partitionColumn" not in tables.options("dim_project")


def test_totals_are_there_without_rows(memory):
    empty = memory()
    assert [(r["event_type"], r["count"], r["count_24h"], r["is_total"]) for r in dicts(regions.event_metrics(empty, AS_OF))] == [(None, 0, 0, True)]
    assert [(r["role"], r["count"], r["is_total"]) for r in dicts(regions.user_metrics(empty))] == [(None, 0, True)]
    assert [tuple(r.values()) for r in dicts(regions.activity_metrics(empty, AS_OF))] == [(None, None, 0, 0)]


def test_activity_totals_in_an_empty_week(memory):
    old = [{"user_id": 1, "event_type": "E", "occurred_at": "2023-06-01 00:00:00"}] * 3
    assert [tuple(r.values()) for r in dicts(regions.activity_metrics(memory(fact_user_activity=old), AS_OF))] == [(None, None, 3, 0)]


def test_users_without_a_role_are_not_the_total(memory):
    users = [{"user_id": i, "role": r} for i, r in ((1, "A"), (2, None), (3, "A"))]
    got = [(r["role"], r["count"], r["is_total"]) for r in dicts(regions.user_metrics(memory(dim_users=users)))]
    assert sorted(got, key=str) == sorted([(None, 3, True), ("A", 2, False), (None, 1, False)], key=str)
