"""What is sent and kept when events are told apart, and when a rollup is made for the first time."""

import itertools

from pyspark.sql import functions as F

from tests.helpers import dicts, frame, message, messages
from tradewind.operators import dedup
from tradewind.plans import refresh
from tradewind.sources import messages as msg
from tradewind.streaming import intake

ROWS = [
    ("once", 1, "text b", "kept"),
    ("copied", 1, "text a", "kept"),
    ("copied", 1, "text a", "kept"),
    ("earlier", 2, "text a", "lost"),
    ("earlier", 1, "text b", "kept"),
    *(("split", 1, f"text {n}", "kept" if n == 10 else "lost") for n in range(10, 40)),
    ("split", 2, "text 0", "lost"),
]


def test_texts_decide_only_where_all_else_is_equal(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "id string, at int, text string, rest string")
    found = dedup.first_by_text(rows, "id", ("at",), "text", str(tmp_path / "found"))
    assert sorted((r.id, r.at, r.rest) for r in found.collect()) == [(k, 1, "kept") for k in ("copied", "earlier", "once", "split")]
    assert "text" not in spark.read.parquet(str(tmp_path / "found")).columns


def test_without_split_keys_no_text_is_compared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "first_per_key", None)
    rows = spark.createDataFrame(ROWS[:5], "id string, at int, text string, rest string")
    assert dedup.first_by_text(rows, "id", ("at",), "text", str(tmp_path / "found")).count() == 3


def test_a_batch_sends_messages_as_they_came(spark):
    late, early = message("user", "e1", at="2024-01-10T10:00:01Z"), message("user", "e1", username="bob")
    usable = msg.usable(msg.decode(msg.route(messages(spark, late, early, early))))
    first = intake.first_messages(usable)
    assert dicts(first, "routing_key", "value") == [{"routing_key": early[0], "value": early[1]}]
    sent = [line for line in first._jdf.queryExecution().executedPlan().toString().split("\n") if "SortAggregate" in line]
    assert sent and not any("min_by" in line for line in sent)


def test_facts_are_stored_as_zstandard(spark, warehouse):
    tx = warehouse.begin()
    tx.append("fact_trade", frame(spark, "fact_trade", [{"order_id": "1", "executed_at": "2024-01-05 00:00:00"}]))
    assert all(".zstd." in f for f in (r.f for r in warehouse.folders_as_table("fact_trade", tx.state.folders("fact_trade")).select(F.input_file_name().alias("f")).collect()))


def test_a_first_refresh_merges_nothing(spark, warehouse, monkeypatch):
    rows = [{"order_id": str(n), "buyer_id": n % 2, "amount": 5, "executed_at": f"2024-01-0{n} 00:00:00"} for n in itertools.chain(range(1, 4), range(2, 4))]
    tx = warehouse.begin()
    tx.append("fact_trade", frame(spark, "fact_trade", rows))
    tx.commit()
    monkeypatch.setattr(refresh, "merged", None)
    assert refresh.refresh(warehouse, "mv_trades_daily") == "SUCCESS"
    assert sorted(r["trade_count"] for r in dicts(warehouse.rollup("mv_trades_daily"))) == [1, 2, 2]
