from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import AS_OF, dicts, frame
from tradewind.operators import maintenance, refreshes, rollups
from tradewind.plans import refresh
from tradewind.schemas import TABLES
from tradewind.streaming import intake


def trades(spark, *rows):
    return frame(
        spark,
        "fact_trade",
        [
            {"order_id": i, "buyer_id": 1, "seller_id": 2, "quantity": 1, "unit_price": 1, "amount": a, "executed_at": at}
            for i, a, at in rows
        ],
    )


def store(warehouse, table, df, months=None):
    tx = warehouse.begin()
    tx.append(table, df) if months is None else tx.replace(table, df, months)
    tx.commit()


def direct(warehouse, name):
    spec = rollups.ROLLUPS[name]
    return spec.build(warehouse.read(spec.fact))


def rows(df):
    return sorted(map(str, dicts(df)))


def test_refresh_equals_direct_aggregation_and_is_logged(spark, warehouse):
    store(warehouse, "fact_trade", trades(spark, ("a", 1, "2024-01-05 01:00:00"), ("b", 2, "2024-01-05 02:00:00")))
    assert refresh.refresh_all(warehouse) == dict.fromkeys(rollups.ROLLUPS, "SUCCESS")
    assert rows(warehouse.rollup("mv_trades_daily")) == rows(direct(warehouse, "mv_trades_daily"))
    log = {r["mv_name"]: (r["status"], r["rows_affected"]) for r in dicts(refresh.refresh_log(warehouse))}
    assert log["mv_trades_daily"] == ("SUCCESS", 1) and len(log) == 4
    assert warehouse.read("mv_refresh_log").count() == 4  # start and end are one row
    # The store's clock is the machine's, so the window of the statistics ends a day from now.
    as_of = intake.utc_now() + timedelta(days=1)
    for name in rollups.ROLLUPS:
        (stats,) = dicts(refreshes.stats(warehouse, as_of, name))
        assert (stats["total_refreshes"], stats["successful"], stats["failed"]) == (1, 1, 0)
        assert [r["status"] for r in dicts(refreshes.history(warehouse, name))] == ["SUCCESS"]
    assert [r["status"] for r in dicts(refreshes.history(warehouse))] == ["SUCCESS"] * 4
    assert {r["view_name"]: r["is_stale"] for r in dicts(refreshes.status(warehouse, as_of))} == dict.fromkeys(rollups.ROLLUPS, True)


def test_only_changed_months_are_recomputed(spark, warehouse):
    store(warehouse, "fact_trade", trades(spark, ("a", 1, "2023-11-05 00:00:00"), ("b", 2, "2024-01-05 00:00:00")))
    refresh.refresh(warehouse, "mv_trades_daily")
    old = warehouse.state().tables["mv_trades_daily"]
    store(warehouse, "fact_trade", trades(spark, ("c", 3, "2024-01-06 00:00:00")))
    refresh.refresh(warehouse, "mv_trades_daily")
    new = warehouse.state().tables["mv_trades_daily"]
    assert new["2023-11"] == old["2023-11"] and new["2024-01"] != old["2024-01"]
    assert rows(warehouse.rollup("mv_trades_daily")) == rows(direct(warehouse, "mv_trades_daily"))
    tx = warehouse.begin()
    tx.drop_months("fact_trade", ["2023-11"])
    tx.commit()
    refresh.refresh(warehouse, "mv_trades_daily")
    assert rows(warehouse.rollup("mv_trades_daily")) == rows(direct(warehouse, "mv_trades_daily"))


def test_failed_refresh_keeps_the_rollup_and_is_logged(spark, warehouse):
    store(warehouse, "fact_trade", trades(spark, ("a", 1, "2024-01-05 00:00:00")))
    refresh.refresh(warehouse, "mv_trades_daily")
    before = rows(warehouse.rollup("mv_trades_daily"))
    store(warehouse, "fact_trade", trades(spark, ("b", 1, "2024-01-06 00:00:00")))
    boom = F.raise_error(F.lit("boom" * 1000)).cast("bigint")
    status = refresh.refresh(
        warehouse, "mv_trades_daily", build=lambda df: rollups.trades_daily(df).withColumn("trade_count", boom)
    )
    assert status == "FAILED" and rows(warehouse.rollup("mv_trades_daily")) == before
    failed = [r for r in dicts(refresh.refresh_log(warehouse)) if r["status"] == "FAILED"]
    assert len(failed) == 1 and "boom" * 1000 in failed[0]["error_message"]  # whole
    (stats,) = dicts(refreshes.stats(warehouse, intake.utc_now() + timedelta(days=1), "mv_trades_daily"))
    assert (stats["total_refreshes"], stats["successful"], stats["failed"]) == (2, 1, 1)


def test_old_plus_difference_is_new(spark, warehouse, memory):
    old = trades(spark, ("a", 1, "2024-01-05 00:00:00"), ("b", 1, "2024-01-06 00:00:00"), ("c", 1, "2023-11-06 00:00:00"))
    tx = warehouse.begin()
    tx.replace("mv_trades_daily", rollups.trades_daily(old))
    tx.commit()
    unchanged = warehouse.state().tables["mv_trades_daily"]["2023-11"]
    facts = [
        {"order_id": i, "buyer_id": 1, "seller_id": 2, "quantity": 1, "unit_price": 1, "amount": a, "executed_at": at}
        for i, a, at in (("a", 9, "2024-01-05 00:00:00"), ("c", 1, "2023-11-06 00:00:00"), ("d", 1, "2024-01-07 00:00:00"))
    ]
    tables = memory(fact_trade=facts)
    changes = refresh.refresh_by_difference(warehouse, "mv_trades_daily", tables)
    assert {(str(r["day"])[:10], r["change"]) for r in dicts(changes)} == {
        ("2024-01-05", "UPDATE"),
        ("2024-01-06", "DELETE"),
        ("2024-01-07", "INSERT"),
    }
    assert rows(warehouse.rollup("mv_trades_daily")) == rows(tables.rollup("mv_trades_daily"))
    assert warehouse.state().tables["mv_trades_daily"]["2023-11"] == unchanged


def test_retention_drops_folders(spark, warehouse):
    store(warehouse, "fact_trade", trades(spark, ("a", 1, "2021-12-31 00:00:00"), ("b", 1, "2022-01-01 00:00:00")))
    assert refresh.apply_retention(warehouse, AS_OF)["fact_trade"] == ["2021-12"]
    assert [r["order_id"] for r in dicts(warehouse.read("fact_trade"))] == ["b"]


def test_purge(spark, warehouse):
    day = timedelta(days=1)
    store(
        warehouse,
        "mv_refresh_log",
        frame(
            spark,
            "mv_refresh_log",
            [
                {"mv_name": "m", "refresh_started_at": AS_OF - 31 * day, "status": "SUCCESS"},
                {"mv_name": "m", "refresh_started_at": AS_OF - 30 * day, "status": "RUNNING"},
            ],
        ),
    )
    store(
        warehouse,
        "system_notifications",
        frame(
            spark,
            "system_notifications",
            [
                {"notification_id": "old", "expires_at": AS_OF - day},
                {"notification_id": "now", "expires_at": AS_OF},
                {"notification_id": "never"},
            ],
        ),
    )
    refresh.purge(warehouse, AS_OF)
    assert dicts(warehouse.read("mv_refresh_log"), "status") == [{"status": "RUNNING"}]
    left = sorted(r["notification_id"] for r in dicts(warehouse.read("system_notifications")))
    assert left == ["never", "now"]


def test_missing_months(memory):
    tables = memory(
        fact_payment=[
            {"payment_id": "a", "completed_at": "2023-10-01 00:00:00"},
            {"payment_id": "b", "completed_at": "2024-01-01 00:00:00"},
        ]
    )
    missing = maintenance.partition_coverage(tables, AS_OF, "fact_payment")
    assert [r["missing_month"] for r in dicts(missing)] == ["2023-11", "2023-12", "2024-02"]


def test_latest_only(spark):
    df = trades(spark, ("a", 1, "2024-01-05 00:00:00"), ("a", 2, "2024-01-06 00:00:00"), ("b", 3, "2024-01-05 00:00:00"))
    newest = rollups.latest_only(df, "order_id", "executed_at")
    assert newest.columns == TABLES["fact_trade"].columns
    assert sorted((r["order_id"], int(r["amount"])) for r in dicts(newest)) == [("a", 2), ("b", 3)]
