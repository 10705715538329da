"""What is kept beside the rows it concerns: seen event ids, user changes, read receipts, places in a list, bloom filters."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import AS_OF, UUID, dicts, frame, message, messages
from tests.test_intake import FIRST, SECOND, contents, run
from tradewind.operators import dedup, logs, notifications, paging, upserts
from tradewind.plans import refresh
from tradewind.sources import messages as msg
from tradewind.sources.warehouse import USERS_FOLDED, Warehouse
from tradewind.streaming import intake

# ---- seen ids


def deliver(spark, folder, *files):
    """One file per batch of the stream, read in order."""
    os.makedirs(folder, exist_ok=True)
    for rows in files:
        n = len(os.listdir(folder))
        part = f"{folder}/{n:03}.json"
        with open(part, "w") as out:
            out.writelines(f"{line}\n" for line in messages(spark, *rows).toJSON().collect())
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))


def stream_in(spark, warehouse, tmp_path, **options):
    stream = msg.message_stream(spark, str(tmp_path / "inbox"), maxFilesPerTrigger="1")
    started = intake.start(warehouse, stream, str(tmp_path / "progress"), clock=lambda: AS_OF, available_now=True, **options)
    started.awaitTermination()


def test_redelivery_in_a_batch_across_batches_and_after_a_restart(spark, warehouse, tmp_path, monkeypatch):
    ledger, usual = [], Warehouse.load

    def load(self, name, *args, **options):
        ledger.append(name == "consumed_events")
        return usual(self, name, *args, **options)

    monkeypatch.setattr(Warehouse, "load", load)
    trades = [message("trade", f"t{i}", orderId=UUID(i), amount=i + 1) for i in range(4)]
    deliver(spark, str(tmp_path / "inbox"), [trades[0], trades[0], trades[1]], [trades[1], trades[2]])
    stream_in(spark, warehouse, tmp_path)
    deliver(spark, str(tmp_path / "inbox"), [trades[0], trades[2], trades[3], trades[3]])
    stream_in(spark, warehouse, tmp_path)  # a new query over the same checkpoint
    assert not any(ledger)
    monkeypatch.undo()
    assert sorted(r["event_id"] for r in dicts(warehouse.read("consumed_events"))) == ["t0", "t1", "t2", "t3"]
    assert warehouse.read("fact_trade").count() == 4 and warehouse.read("dead_letters").count() == 0
    assert warehouse.state().marks["intake"] == 2


def test_refused_and_repeated_events_of_a_stream(spark, warehouse, tmp_path):
    """A refused event does not use up its id; of several deliveries in a batch the earliest counts; an issuance without status keeps its fact row
    unless its event was consumed before."""
    bad = message("trade", "t1", buyerId="x")
    later = message("trade", "t2", orderId=UUID(2), at="2024-01-12T00:00:00Z", amount=2)
    no_status = message("issuance", "i1", status=None, quantityTco2e=5)
    deliver(
        spark,
        str(tmp_path / "inbox"),
        [bad, message("issuance", "i1"), later, message("trade", "t2", orderId=UUID(2), amount=1), later],
        [message("trade", "t1"), no_status, message("issuance", "i2", requestId="r2", status=None)],
        [bad, message("trade", "t1", amount=9)],
    )
    stream_in(spark, warehouse, tmp_path)
    assert {r["order_id"]: int(r["amount"]) for r in dicts(warehouse.read("fact_trade"))} == {UUID(1): 20, UUID(2): 1}
    assert {r["issuance_id"]: (r["status"], float(r["quantity_tco2e"])) for r in dicts(warehouse.read("fact_issuance"))} == {"r1": ("PENDING", 1.005), "r2": (None, 1.005)}
    assert warehouse.read("dead_letters").count() == 4


def test_a_batch_committed_but_not_checkpointed_is_replayed(spark, warehouse, tmp_path):
    """The driver dies between the warehouse's commit and the stream's: the state takes the batch in, the tables do not."""
    deliver(spark, str(tmp_path / "inbox"), FIRST, SECOND)

    def die(_, batch_id):
        if batch_id == 0:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream_in(spark, warehouse, tmp_path, between=die)
    assert warehouse.state().marks["intake"] == 0
    stream_in(spark, warehouse, tmp_path)
    other = Warehouse(spark, str(tmp_path / "other"))
    run(other, spark, 0, *FIRST)
    run(other, spark, 1, *SECOND)
    assert contents(warehouse) == contents(other)
    deliver(spark, str(tmp_path / "inbox"), FIRST)
    stream_in(spark, warehouse, tmp_path)
    assert warehouse.read("consumed_events").count() == 8


def test_bounded_memory_of_ids(spark, tmp_path):
    """With a delay, old ids are forgotten: a copy within it goes, one long after it comes through."""
    inbox = str(tmp_path / "in")
    for n, times in enumerate((["2024-01-01 00:00:00"], ["2024-01-01 00:30:00", "2024-01-05 00:00:00"], ["2024-01-06 00:00:00"], ["2024-01-06 00:10:00"])):
        rows = [("a" if n != 1 or i == 0 else "b", t) for i, t in enumerate(times)]
        spark.createDataFrame(rows, "event_id string, t string").selectExpr("event_id", "cast(t as timestamp) at").coalesce(1).write.parquet(f"{inbox}/{n}")
        stream = spark.readStream.schema("event_id string, at timestamp").parquet(f"{inbox}/*")
        kept = dedup.once(stream, "event_id", "at", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        kept.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = sorted((r["event_id"], str(r["at"])) for r in dicts(spark.read.parquet(str(tmp_path / "out"))))
    assert found == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-06 00:00:00"), ("b", "2024-01-05 00:00:00")]


# ---- users


def user(i, action, day, **fields):
    event = f"{day}-{action}-{fields.get('username')}"
    return message("user", f"{i}-{event}", userId=str(i), action=action, at=f"2024-01-{day:02}T00:00:00Z", **({"username": None, "role": None} | fields))


HISTORY = [
    user(1, "REGISTERED", 1, username="ann", role="BUYER"),
    user(1, "UPDATED", 3, email="a@x"),
    user(1, "LOGGED_IN", 5),
    user(1, "UPDATED", 2, username="anna"),
    user(2, "UPDATED", 4, username="late"),
    user(2, "REGISTERED", 2, username="bob", role="SELLER", email="b@x"),
    user(2, "DELETED", 6),
    user(2, "ENABLED", 5),
    user(3, "LOGGED_IN", 5),  # never registered
    user(4, "REGISTERED", 5, username="dee", role="BUYER"),
    user(4, "REGISTERED", 3, username="dora", role="BUYER", region="North"),
]


def test_batches_in_any_order_equal_the_whole_fold(spark, warehouse):
    events = HISTORY[:]
    random.Random(1).shuffle(events)
    for n in range(0, len(events), 4):
        batch = msg.user_events(msg.usable(msg.decode(msg.route(messages(spark, *events[n : n + 4])))))
        tx = warehouse.begin()
        tx.append("dim_user_changes", upserts.user_changes(batch))
        tx.commit()
        if n == 4:
            refresh.fold_users(warehouse)
    decoded = msg.user_events(msg.usable(msg.decode(msg.route(messages(spark, *HISTORY)))))
    whole = upserts.fold_users(frame(spark, "dim_users", []), decoded)
    assert sorted(map(str, dicts(warehouse.read("dim_users")))) == sorted(map(str, dicts(whole)))
    refresh.fold_users(warehouse)
    assert sorted(map(str, dicts(warehouse.read("dim_users")))) == sorted(map(str, dicts(whole)))
    assert len(warehouse.state().folders("dim_user_changes")) == 1


def test_a_login_writes_one_row_and_rewrites_no_folder(spark, warehouse, monkeypatch):
    run(warehouse, spark, 0, user(1, "REGISTERED", 1, username="ann", role="B"), user(2, "REGISTERED", 1, username="bob", role="B"))
    refresh.fold_users(warehouse)
    before = warehouse.state()
    touched = []
    usual = Warehouse.folders_as_table
    monkeypatch.setattr(Warehouse, "folders_as_table", lambda self, name, folders: touched.append(name) or usual(self, name, folders))
    run(warehouse, spark, 1, user(1, "LOGGED_IN", 9))
    assert not {"dim_users", "dim_user_changes"} & set(touched)
    monkeypatch.undo()
    folders = warehouse.state().folders("dim_user_changes")
    assert before.folders("dim_user_changes") == folders[:1] and len(folders) == 2 and warehouse.state().marks[USERS_FOLDED] == folders[0]
    assert warehouse.folders_as_table("dim_user_changes", folders[1:]).count() == 1
    assert {r["user_id"]: str(r["last_login_at"])[:10] for r in dicts(warehouse.read("dim_users"))} == {1: "2024-01-09", 2: "2024-01-01"}


def test_plain_user_rows_count_as_registered_before_all_events(spark, warehouse):
    tx = warehouse.begin()
    tx.replace("dim_users", frame(spark, "dim_users", [{"user_id": i, "username": f"old{i}", "role": "R", "email": "e", "created_at": "2023-01-01 00:00:00"} for i in (1, 5)]))
    tx.commit()
    assert warehouse.read("dim_users").count() == 2
    run(warehouse, spark, 0, user(1, "UPDATED", 3, username="new"))
    for _ in range(2):
        found = {r["user_id"]: (r["username"], r["email"], str(r["created_at"])[:4]) for r in dicts(warehouse.read("dim_users"))}
        assert found == {1: ("new", "e", "2023"), 5: ("old5", "e", "2023")}
        refresh.fold_users(warehouse)
    assert warehouse.state().folders("dim_users") == []


# ---- receipts

NOTES = [
    {"notification_id": "a", "target_user_id": "1", "created_at": "2024-01-01 00:00:00"},
    {"notification_id": "b", "target_user_id": "1", "created_at": "2023-11-01 00:00:00"},
    {"notification_id": "c", "target_user_id": "2", "created_at": "2024-01-02 00:00:00"},
    {"notification_id": "d", "created_at": "2024-01-02 00:00:00"},
    {"notification_id": "e", "target_user_id": "1", "created_at": "2024-01-03 00:00:00", "read_status": True, "read_at": "2024-01-04 00:00:00"},
]


def receipts(spark, *rows):
    return spark.createDataFrame(list(rows), "notification_id string, user_id string, t string").selectExpr("notification_id", "user_id", "cast(t as timestamp) read_at")


def read_at(warehouse):
    return {r["notification_id"]: str(r["read_at"])[:10] for r in dicts(warehouse.read("system_notifications")) if r["read_status"]}


def test_receipts_rewrite_nothing_and_are_seen_at_once(spark, warehouse):
    tx = warehouse.begin()
    tx.replace("system_notifications", frame(spark, "system_notifications", NOTES))
    tx.replace("dim_users", frame(spark, "dim_users", [{"user_id": i, "role": "R"} for i in (1, 2, 3)]))
    tx.commit()
    folders = warehouse.state().folders("system_notifications")
    unread = lambda: {r["user_id"]: r["unread"] for r in dicts(notifications.unread_counts(warehouse))}
    assert unread() == {1: 3, 2: 2, 3: 1}
    refresh.mark_read(warehouse, receipts(spark, ("c", None, "2024-01-05"), ("c", None, "2024-01-06"), ("zzz", None, "2024-01-05"), ("e", None, "2024-01-09")))
    assert read_at(warehouse) == {"c": "2024-01-05", "e": "2024-01-04"} and unread() == {1: 3, 2: 1, 3: 1}
    refresh.mark_read(warehouse, receipts(spark, (None, "1", "2024-01-07")))
    after = {"a": "2024-01-07", "b": "2024-01-07", "c": "2024-01-05", "d": "2024-01-07", "e": "2024-01-04"}
    assert read_at(warehouse) == after and unread() == {1: 0, 2: 0, 3: 0}
    assert warehouse.state().folders("system_notifications") == folders
    tx = warehouse.begin()  # what comes after a receipt for all is unread
    tx.append("system_notifications", frame(spark, "system_notifications", [{"notification_id": "f", "target_user_id": "1", "created_at": "2024-01-01 00:00:00"}]))
    tx.commit()
    assert unread() == {1: 1, 2: 0, 3: 0}
    refresh.fold_reads(warehouse)
    assert read_at(warehouse) == after and warehouse.state().folders("notification_reads") == []


# ---- places in a list


def log(i, at):
    return {"id": f"{i:04}", "log_level": "ERROR", "source_service": "s", "log_timestamp": at, "message": str(i)}


def test_pages_by_place_equal_pages_by_number(spark, warehouse):
    rng = random.Random(6)
    times = [None, *(datetime(2024, 1, 24) + timedelta(hours=rng.randrange(30)) for _ in range(12))]
    rows = frame(spark, "system_logs", [log(i, rng.choice(times)) for i in range(70)]).cache()
    for ascending in (False, True):
        seen, number = None, 0
        while True:
            mine = paging.next_page(rows, "log_timestamp", "id", seen, 8, ascending)
            theirs = paging.page(rows, "log_timestamp", number, 8, ascending)
            assert dicts(mine.rows) == dicts(theirs.rows) and dicts(mine.total) == [{"n": 70}]
            seen, number = paging.last_of(mine, "log_timestamp", "id"), number + 1
            if seen is None:
                break
        assert number == 10


def test_rows_added_between_pages_move_nothing(spark, memory):
    first = [log(i, AS_OF - timedelta(hours=i // 3)) for i in range(30)]
    one = logs.search_on(memory(system_logs=first), AS_OF, size=10)
    grown = memory(system_logs=[log(100 + i, AS_OF) for i in range(5)] + first)
    two = logs.search_on(grown, AS_OF, paging.last_of(one, "log_timestamp", "id"), size=10)
    assert [r["id"] for r in dicts(one.rows) + dicts(two.rows)] == [f"{i:04}" for i in range(20)]


def test_a_deep_page_is_a_top_k_with_a_bound_in_the_scan(spark, warehouse):
    tx = warehouse.begin()
    tx.append("system_logs", frame(spark, "system_logs", [log(i, datetime(2023, 1 + i % 12, 5)) for i in range(48)]))
    tx.commit()
    deep = logs.errors_on(warehouse, (datetime(2023, 4, 5), "9999"), size=4)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        text = deep.rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "TakeOrderedAndProject" in text and "LessThanOrEqual(log_timestamp" in text
    assert [str(r["log_timestamp"])[:7] for r in dicts(deep.rows)] == ["2023-03"] * 4
    assert not any(f"month=2023-{m:02}" in f for f in deep.rows.inputFiles() for m in (1, 2, *range(5, 13)))


# ---- looking values up


def rows_scanned(df):
    """Rows the scans gave to the rest of the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "Scan" in node.getClass().getSimpleName():
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_lookups_skip_row_groups(spark, warehouse):
    rows = spark.range(60_000).select(
        F.md5(F.col("id").cast("string")).alias("id"), F.lit("INFO").alias("log_level"), F.concat(F.lit("c-"), F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("correlation_id"),
        F.concat(F.lit("u-"), F.col("id") % 7919).alias("user_id"), F.timestamp_seconds(F.lit(1_705_000_000) + F.col("id")).alias("log_timestamp"),
    )
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "200000")
    try:
        tx = warehouse.begin()
        tx.append("system_logs", rows)
        tx.commit()
    finally:
        conf.unset("parquet.block.size")
    wanted = rows.filter("correlation_id = 'c-77'").count()
    found = logs.matching(warehouse, datetime(2024, 1, 1), datetime(2024, 2, 1), correlation_id="c-77").select("id", "correlation_id")
    assert found.count() == wanted > 0
    assert rows_scanned(found) < 20_000
    absent = warehouse.read("system_logs").filter("user_id = 'u-none'").select("id")
    assert rows_scanned(absent) == 0  # user ids lie anywhere: only a bloom filter knows
