from datetime import UTC, datetime, timedelta

import pytest

from tests.helpers import AS_OF, dicts, frame
from tradewind.functions.clock import days_back
from tradewind.operators import logs
from tradewind.plans import dashboards, health
from tradewind.schemas import TABLES
from tradewind.sources.warehouse import ConflictError, Warehouse, scratch_folder


def payments(spark, *rows):
    return frame(
        spark,
        "fact_payment",
        [{"payment_id": i, "order_id": "o", "amount": a, "status": "S", "completed_at": at} for i, a, at in rows],
    )


def ids(df):
    return sorted(r["payment_id"] for r in dicts(df, "payment_id"))


def test_nothing_is_seen_before_commit(spark, warehouse):
    tx = warehouse.begin()
    tx.append("fact_payment", payments(spark, ("a", 1, "2024-01-05 00:00:00")))
    assert ids(warehouse.read("fact_payment")) == []
    tx.commit()
    assert ids(warehouse.read("fact_payment")) == ["a"]


def test_window_read_lists_only_late_months(spark, warehouse):
    tx = warehouse.begin()
    tx.append(
        "fact_payment",
        payments(
            spark,
            ("a", 1, "2023-11-05 00:00:00"),
            ("b", 1, "2023-12-31 18:00:00"),
            ("c", 1, "2023-12-31 18:00:01"),
            ("d", 1, "2024-01-05 00:00:00"),
            ("e", 1, "2030-01-05 00:00:00"),
        ),
    )
    tx.commit()
    assert sorted(warehouse.state().tables["fact_payment"]) == ["2023-11", "2023-12", "2024-01", "2030-01"]
    recent = warehouse.read("fact_payment", after=days_back(AS_OF, 30))
    assert ids(recent) == ["c", "d", "e"]
    assert not any("2023-11" in f for f in recent.inputFiles())
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(completed_at), GreaterThan(completed_at" in plan


def test_replace_months_leaves_the_others(spark, warehouse):
    tx = warehouse.begin()
    tx.append("fact_payment", payments(spark, ("a", 1, "2023-11-05 00:00:00"), ("b", 1, "2023-12-05 00:00:00")))
    tx.commit()
    tx = warehouse.begin()
    tx.replace("fact_payment", payments(spark, ("c", 1, "2023-12-06 00:00:00")), ["2023-12"])
    tx.commit()
    assert ids(warehouse.read("fact_payment")) == ["a", "c"]


def test_rows_can_be_replaced_by_what_is_read_from_them(spark, warehouse):
    tx = warehouse.begin()
    tx.append("fact_payment", payments(spark, ("a", 1, "2023-11-05 00:00:00"), ("b", 1, "2023-12-05 00:00:00")))
    tx.commit()
    tx = warehouse.begin()
    tx.replace("fact_payment", warehouse.read("fact_payment").filter("payment_id = 'b'"))
    tx.commit()
    assert ids(warehouse.read("fact_payment")) == ["b"]


def test_second_writer_fails_and_changes_nothing(spark, warehouse):
    one, two = warehouse.begin(), warehouse.begin()
    one.append("fact_payment", payments(spark, ("a", 1, "2023-11-05 00:00:00")))
    two.append("fact_payment", payments(spark, ("b", 1, "2023-11-05 00:00:00")))
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    assert ids(warehouse.read("fact_payment")) == ["a"]


def test_compact_and_vacuum(spark, warehouse):
    for i in range(3):
        tx = warehouse.begin()
        tx.append("fact_payment", payments(spark, (str(i), 1, "2023-11-05 00:00:00")))
        tx.commit()
    tx = warehouse.begin()
    tx.compact("fact_payment")
    tx.commit()
    assert len(warehouse.state().folders("fact_payment")) == 1
    assert ids(warehouse.read("fact_payment")) == ["0", "1", "2"]
    now = datetime.now(UTC).replace(tzinfo=None)
    assert warehouse.vacuum(now) == 0  # by age: nothing is old enough, however many commits there were
    assert len(warehouse.pointers("intake")) == 4
    with pytest.raises(ValueError):
        warehouse.vacuum(now, keep=timedelta(minutes=5))
    assert warehouse.vacuum(now + timedelta(days=2)) == 3
    assert len(warehouse.pointers("intake")) == 1
    assert ids(Warehouse(spark, warehouse.root).read("fact_payment")) == ["0", "1", "2"]


def test_scratch_folder_is_in_the_shared_folder(spark):
    assert scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_writers_of_different_tables_both_succeed(spark, warehouse):
    one, two = warehouse.begin(), warehouse.begin()
    one.append("fact_payment", payments(spark, ("a", 1, "2023-11-05 00:00:00")))
    one.mark("x", 1)
    two.append("mv_refresh_log", frame(spark, "mv_refresh_log", [{"mv_name": "m", "refresh_started_at": AS_OF, "status": "RUNNING"}]))
    assert (one.commit(), two.commit()) == (1, 1)
    assert ids(warehouse.read("fact_payment")) == ["a"] and warehouse.read("mv_refresh_log").count() == 1
    assert warehouse.state().marks == {"x": 1}


def test_one_transaction_writes_one_pointer(spark, warehouse):
    tx = warehouse.begin()
    tx.append("fact_payment", payments(spark, ("a", 1, "2023-11-05 00:00:00")))
    tx.append("mv_refresh_log", frame(spark, "mv_refresh_log", [{"mv_name": "m", "refresh_started_at": AS_OF, "status": "RUNNING"}]))
    with pytest.raises(ValueError):
        tx.commit()


def test_folders_that_are_gone_are_not_replaced(spark, warehouse):
    tx = warehouse.begin()
    tx.append("fact_payment", payments(spark, ("a", 1, "2023-11-05 00:00:00")))
    tx.commit()
    (old,) = warehouse.state().folders("fact_payment")
    tx = warehouse.begin()
    tx.replace("fact_payment", payments(spark, ("b", 1, "2023-11-05 00:00:00")))
    tx.commit()
    with pytest.raises(ConflictError):
        warehouse.begin().replace_folders("fact_payment", [old], payments(spark, ("c", 1, "2023-11-05 00:00:00")))


def test_columns_renamed_since_are_read(spark, warehouse):
    """A folder written before ``org`` became ``organization_name``."""
    tx = warehouse.begin()
    tx.append("dim_users", frame(spark, "dim_users", [{"user_id": 1, "role": "R", "organization_name": "new"}]))
    tx.commit()
    (folder,) = warehouse.state().folders("dim_users")
    old = frame(spark, "dim_users", [{"user_id": 2, "role": "R", "organization_name": "old"}]).withColumnRenamed("organization_name", "org")
    old.write.mode("append").parquet(f"{warehouse.root}/{folder}")
    assert {r["user_id"]: r["organization_name"] for r in dicts(warehouse.read("dim_users"))} == {1: "new", 2: "old"}


def test_newest_rows_leave_old_months_unread(spark, warehouse):
    days = ("2023-10-05", "2023-11-05", "2023-12-05", "2024-01-05")
    for table, time, key in (("fact_trade", "executed_at", "order_id"), ("consumed_events", "received_at", "event_id"), ("system_logs", "log_timestamp", "id")):
        rows = [{key: d, time: f"{d} 00:00:00", "log_level": "ERROR" if d < "2023-12" else "INFO", "source_service": "s"} for d in days]
        tx = warehouse.begin()
        tx.append(table, frame(spark, table, [{k: v for k, v in r.items() if k in TABLES[table].columns} for r in rows]))
        tx.commit()
    old = lambda df: any("month=2023-10" in f for f in df.inputFiles())
    newest = dashboards.recent_trades(warehouse, n=2)
    assert [r["order_id"] for r in dicts(newest)] == ["2024-01-05", "2023-12-05"] and not old(newest)
    assert [r["event_id"] for r in dicts(health.latest_event(warehouse))] == ["2024-01-05"] and not old(health.latest_event(warehouse))
    found = logs.errors(warehouse, size=1)
    assert [r["id"] for r in dicts(found.rows)] == ["2023-11-05"] and not old(found.rows)
    assert dicts(found.total) == [{"n": 2}]
    everything = logs.by_field(warehouse, "source_service", "s", number=1, size=3).rows
    assert [r["id"] for r in dicts(everything)] == ["2023-10-05"]
