import os

import pytest

from tests.helpers import AS_OF, UUID, dicts, message, messages
from tradewind.plans import refresh
from tradewind.sources import messages as msg
from tradewind.sources.warehouse import ConflictError
from tradewind.streaming import intake, windows

TABLES = ("fact_trade", "fact_payment", "fact_issuance", "fact_user_activity", "dim_users", "consumed_events",
          "system_logs", "system_notifications", "dead_letters")


def contents(warehouse):
    return {t: sorted(map(str, dicts(warehouse.read(t)))) for t in TABLES}


def run(warehouse, spark, batch_id, *rows):
    intake.process_batch(warehouse, messages(spark, *rows), batch_id, AS_OF)


FIRST = (
    message("user", "u1"),
    message("user", "u1"),
    message("trade", "t1", amount=2000000),
    message("trade", "t2", buyerId="x1"),
    message("payment", "p1"),
    message("issuance", "i1"),
    message("issuance", "i2", requestId="r2", status=None),
    ("auth.user.banned", "{}"),
    ("auth.user.updated", "{broken"),
)
SECOND = (
    message("user", "u1", username="again"),
    message("user", "u2", action="UPDATED", username="bea", at="2024-01-11T00:00:00Z"),
    message("trade", "t3", amount=7),
    message("trade", "t4", orderId=UUID(2), at="2023-10-01T00:00:00Z"),
    message("payment", "p2", amount=9, status="FAILED"),
)


def counts(warehouse):
    return {t: warehouse.read(t).count() for t in TABLES}


def test_two_batches(spark, warehouse):
    run(warehouse, spark, 0, *FIRST)
    assert counts(warehouse) == {
        "fact_trade": 1,
        "fact_payment": 1,
        "fact_issuance": 2,  # the one without status keeps its fact row
        "fact_user_activity": 1,
        "dim_users": 1,
        "consumed_events": 4,
        "system_logs": 7,
        "system_notifications": 3,
        "dead_letters": 3,
    }
    run(warehouse, spark, 1, *SECOND)
    trades = {r["order_id"]: r for r in dicts(warehouse.read("fact_trade"))}
    assert {o: int(r["amount"]) for o, r in trades.items()} == {UUID(1): 7, UUID(2): 20}
    assert sorted(warehouse.state().tables["fact_trade"]) == ["2023-10", "2024-01"]
    (payment,) = dicts(warehouse.read("fact_payment"))
    assert (int(payment["amount"]), payment["status"]) == (5, "FAILED")
    (user,) = dicts(warehouse.read("dim_users"))
    assert user["username"] == "bea"
    assert warehouse.read("consumed_events").count() == 8


def test_replay_of_a_committed_batch_changes_nothing(spark, warehouse):
    run(warehouse, spark, 0, *FIRST)
    before, commits = contents(warehouse), warehouse.state().number
    run(warehouse, spark, 0, *FIRST)
    assert contents(warehouse) == before and warehouse.state().number == commits


def test_redelivery_under_a_new_batch_changes_no_facts(spark, warehouse):
    run(warehouse, spark, 0, *FIRST)
    before = contents(warehouse)
    run(warehouse, spark, 1, *FIRST)
    after = contents(warehouse)
    refused = ("dead_letters", "system_logs")  # refused messages are refused, and logged, again
    assert {t: r for t, r in after.items() if t not in refused} == {
        t: r for t, r in before.items() if t not in refused
    }


def test_failure_in_the_middle_leaves_the_old_state(spark, warehouse, monkeypatch):
    run(warehouse, spark, 0, *FIRST)
    before = contents(warehouse)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(intake.notices, "ledger_rows", broken)
    with pytest.raises(RuntimeError):
        run(warehouse, spark, 1, *SECOND)
    assert contents(warehouse) == before
    monkeypatch.undo()
    run(warehouse, spark, 1, *SECOND)
    assert warehouse.read("consumed_events").count() == 8


def test_only_folders_with_a_conflict_are_rewritten(spark, warehouse):
    run(warehouse, spark, 0, message("trade", "t1"))
    run(warehouse, spark, 1, message("trade", "t2", orderId=UUID(2)))
    first, second = warehouse.state().folders("fact_trade")
    run(warehouse, spark, 2, message("trade", "t3", orderId=UUID(2), amount=1))
    folders = warehouse.state().folders("fact_trade")
    assert first in folders and second not in folders
    assert warehouse.read("fact_trade").count() == 2


def test_stream_equals_batches(spark, warehouse, tmp_path):
    inbox = tmp_path / "inbox"
    for i, rows in enumerate((FIRST, SECOND)):
        messages(spark, *rows).coalesce(1).write.json(str(inbox / f"d{i}"))
    paths = sorted(str(p) for p in inbox.rglob("*.json"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, p in enumerate(paths):
        target = flat / f"{i}.json"
        target.write_text(open(p).read())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = msg.message_stream(spark, str(flat), maxFilesPerTrigger="1")
    run_ = intake.start(warehouse, stream, str(tmp_path / "progress"), clock=lambda: AS_OF, available_now=True)
    run_.awaitTermination()
    assert warehouse.state().marks["intake"] == 1
    by_stream = contents(warehouse)

    other = type(warehouse)(spark, str(tmp_path / "other"))
    run(other, spark, 0, *FIRST)
    run(other, spark, 1, *SECOND)
    assert by_stream == contents(other)


def test_window_counts_take_late_events(spark, tmp_path):
    inbox = tmp_path / "in"
    for times in (["2024-01-05 10:10:00", "2024-01-05 11:10:00"], ["2024-01-05 10:50:00"]):
        rows = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("cast(t as timestamp) at")
        rows.coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema("at timestamp").parquet(str(inbox))
        counts_ = windows.event_counts(stream, "at", "1 hour", "2 hours")
        windows.keep_counts(counts_, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    result = {str(r["start"]): r["count"] for r in dicts(windows.read_counts(spark, str(tmp_path / "out")))}
    assert result == {"2024-01-05 10:00:00": 2, "2024-01-05 11:00:00": 1}


def test_folders_of_users_are_only_added(spark, warehouse):
    run(warehouse, spark, 0, message("user", "u1", userId="1", at="2023-11-01T00:00:00Z"))
    run(warehouse, spark, 1, message("user", "u2", userId="2", at="2024-01-01T00:00:00Z"))
    old = warehouse.state().folders("dim_user_changes")
    run(warehouse, spark, 2, message("user", "u3", userId="2", action="UPDATED", username="new"))
    assert warehouse.state().folders("dim_user_changes")[:2] == old and warehouse.state().folders("dim_users") == []
    names = {r["user_id"]: r["username"] for r in dicts(warehouse.read("dim_users"))}
    assert names == {1: "ann", 2: "new"}


def _meanwhile(monkeypatch, act):
    """``act`` runs once, after the batch is decoded and before anything is written."""
    usual, done = intake.notices.counters, []

    def counters(processed):
        if not done:
            done.append(True)
            act()
        return usual(processed)

    monkeypatch.setattr(intake.notices, "counters", counters)


def test_compaction_during_a_batch_gives_no_duplicates(spark, warehouse, monkeypatch):
    run(warehouse, spark, 0, message("trade", "t1"))
    run(warehouse, spark, 1, message("trade", "t2", orderId=UUID(2)))
    _meanwhile(monkeypatch, lambda: refresh.compact(warehouse, least=2))
    with pytest.raises(ConflictError):
        run(warehouse, spark, 2, message("trade", "t3", amount=1))
    monkeypatch.undo()
    run(warehouse, spark, 2, message("trade", "t3", amount=1))
    assert sorted((r["order_id"], int(r["amount"])) for r in dicts(warehouse.read("fact_trade"))) == [(UUID(1), 1), (UUID(2), 20)]


def test_a_second_intake_of_the_same_batch_fails(spark, warehouse, monkeypatch):
    _meanwhile(monkeypatch, lambda: run(warehouse, spark, 0, *FIRST))
    with pytest.raises(ConflictError):
        run(warehouse, spark, 0, *FIRST)
    once = counts(warehouse)
    assert once["consumed_events"] == 4 and once["fact_payment"] == 1 and once["dim_users"] == 1


def test_maintenance_between_batches(spark, warehouse, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i, rows in enumerate((FIRST, SECOND)):
        messages(spark, *rows).coalesce(1).write.json(str(tmp_path / f"d{i}"))
        (part,) = (tmp_path / f"d{i}").glob("*.json")
        (inbox / f"{i}.json").write_text(part.read_text())
        os.utime(inbox / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))

    def between(store, batch_id):
        refresh.compact(store, least=2)
        refresh.purge(store, AS_OF)
        unread = store.read("system_notifications").filter("NOT read_status")
        reads = unread.selectExpr("notification_id", "cast(NULL AS bigint) AS user_id", "timestamp '2024-01-30 00:00:00' AS read_at")
        refresh.mark_read(store, reads)

    stream = msg.message_stream(spark, str(inbox), maxFilesPerTrigger="1")
    started = intake.start(warehouse, stream, str(tmp_path / "cp"), clock=lambda: AS_OF, available_now=True, between=between)
    started.awaitTermination()
    assert warehouse.state().marks["intake"] == 1
    other = type(warehouse)(spark, str(tmp_path / "other"))
    run(other, spark, 0, *FIRST)
    run(other, spark, 1, *SECOND)
    same = [t for t in TABLES if t != "system_notifications"]
    assert {t: contents(warehouse)[t] for t in same} == {t: contents(other)[t] for t in same}
    assert warehouse.read("system_notifications").filter("NOT read_status").count() == 0
    assert all(len(f) == 1 for t in ("fact_trade", "system_logs") for f in warehouse.state().tables[t].values())


def test_window_counts_without_a_bound_lose_nothing(spark, tmp_path):
    """Files 60 days apart, the older one read last; with a bound, what is dropped is found."""
    inbox, days = tmp_path / "in", ("2024-03-05 10:00:00", "2024-01-05 10:00:00")
    for bound, expected in ((None, 2), ("1 day", 1)):
        out = tmp_path / f"out-{bound}"
        for n, day in enumerate(days):
            if bound is None:
                spark.createDataFrame([(day,)], "t string").selectExpr("cast(t as timestamp) at").coalesce(1).write.parquet(str(inbox / f"{n}"))
            stream = spark.readStream.schema("at timestamp").parquet(f"{inbox}/{'[0-%d]' % n}")
            kept = windows.event_counts(stream, "at", "1 day", bound)
            windows.keep_counts(kept, str(out), str(tmp_path / f"cp-{bound}")).awaitTermination()
        found = windows.read_counts(spark, str(out))
        assert found.count() == expected
        missing = windows.late_events(spark.read.parquet(f"{inbox}/[0-1]"), found, "at", "1 day")
        assert missing.count() == 2 - expected
