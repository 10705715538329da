"""What the plans look like, and that hot keys are split."""

import pytest
from pyspark.sql import functions as F

from checks.queries import all_decoded, queries
from tests.helpers import dicts, frame
from tradewind.operators import dedup, notices, refreshes, rollups, upserts
from tradewind.plans import dashboards, refresh
from tradewind.sources.fixtures import AS_OF, FixtureTables
from tradewind.sources.kept import Kept

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def given(spark):
    return FixtureTables(spark, FOLDER)


def test_window_bound_reaches_the_scan(given):
    text = plan(dashboards.trade_timeline(given, AS_OF))
    assert "GreaterThanOrEqual(l_shipdate,2001-10-06T00:00)" in text
    assert "l_comment" not in text and "l_tax" not in text


def test_only_needed_columns_are_read(given):
    text = plan(dashboards.event_processing_series(given, AS_OF))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in text


def test_top_k_is_not_a_full_sort(given):
    assert "TakeOrderedAndProject" in plan(dashboards.recent_trades(given))


RUN_JOBS = {"stream_intake", "stream_events_daily", "stream_events_hourly", "mv_refresh_one", "mv_refresh_all", "sink_fact_by_month", "stream_events_bounded"}


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_join_and_no_python_rows(spark, name, monkeypatch):
    if name in RUN_JOBS:
        pytest.skip("runs jobs when built")
    text = plan(queries()[name](spark, FOLDER))
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert slow not in text


def test_difference_is_an_equi_join(spark, given):
    daily = given.rollup("mv_user_activity_daily")
    text = plan(rollups.difference(daily, daily.filter("event_count > 3"), ("day", "event_type")))
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text


def test_stored_facts_are_not_shuffled_by_an_upsert(spark, warehouse):
    rows = frame(spark, "fact_trade", [{"order_id": str(i), "executed_at": "2024-01-05 00:00:00", "amount": i} for i in range(9)])
    tx = warehouse.begin()
    tx.append("fact_trade", rows)
    tx.commit()
    stored = warehouse.read("fact_trade")
    arriving = rows.filter("order_id < '3'").selectExpr("*", "executed_at AS arrived_at", "order_id AS event_id").cache()
    arriving.count()  # as the intake does: then the size of the batch is known before the join is planned
    merged = upserts.upsert(stored, arriving, "fact_trade")
    assert merged.count() == 9
    text = plan(merged)
    scans = [n for n, line in enumerate(text.split("\n")) if "FileScan parquet" in line]
    above = [path_to_root(text, n) for n in scans]
    assert len(above) == 2  # whole rows, and keys alone
    assert not any("Exchange hashpartitioning" in line for line in above[0])


def path_to_root(text, n):
    """The operators above a line of a plan's tree."""
    lines = text.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    found, at = [], depth(lines[n])
    for line in reversed(lines[:n]):
        if line.strip() and depth(line) < at:
            found.append(line)
            at = depth(line)
    return found


def test_hot_user_is_counted_before_the_join(given):
    text = plan(dashboards.top_active_users(given, AS_OF))
    join = text.index("Join")
    assert "partial_count(1)" in text[join:]


def test_hot_event_id_is_combined_before_the_shuffle(spark):
    hot = spark.range(0, 60_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("event_id"), "id"
    )
    once = dedup.first_per_key(hot, "event_id", F.col("id"))
    assert "partial_min_by" in plan(once)
    assert once.count() == 40_001
    assert dicts(once.filter("event_id = 'hot'"), "id") == [{"id": 0}]


def test_aqe_splits_a_hot_key_in_a_lookup_join(spark):
    """The lookups in this library are joins of facts to rows unique by key; AQE may split the fact side."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997).alias("k")
        facts = spark.range(0, 300_000, 1, 8).select(key, "id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
        names = spark.range(997).select(F.col("id").alias("k"), F.col("id").cast("string").alias("name"))
        joined = facts.join(names, "k", "left")
        joined.write.format("noop").mode("overwrite").save()
        rows = joined.groupBy("name").count()
        assert rows.agg(F.sum("count")).first()[0] == 300_000
        final = rows._jdf.queryExecution().executedPlan()
        rows.collect()
        assert "skew=true" in final.toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_filter_on_the_reason_does_not_repeat_the_checks(given):
    rejected = all_decoded(given).filter("reason IS NOT NULL").select("reason", "event_id")
    assert plan(rejected).count("THEN bad auction id") == 1


def test_words_are_upper_cased_after_they_are_counted(given):
    text = plan(notices.counters(all_decoded(given)))
    assert "upper(" not in text[text.index("Exchange hashpartitioning") :]


def test_payload_fields_are_read_in_one_go(spark):
    text = plan(queries()["sink_payload_json"](spark, FOLDER))
    assert "get_json_object(payload" not in text and text.count("json_tuple(") == 4


def test_all_trades_look_customers_up_once_for_each_order(given):
    text = plan(given.read("fact_trade"))
    scan = next(n for n, line in enumerate(text.split("\n")) if "FileScan parquet" in line and "l_orderkey" in line)
    joins = [line for line in path_to_root(text, scan) if "Join" in line]
    assert any("o_orderkey" in line for line in joins) and not any("c_custkey" in line for line in joins)


def test_a_whole_trade_rollup_does_not_join_again_for_each_aggregation(given):
    text = plan(given.rollup("mv_trades_daily"))
    assert "l_shipdate" not in text and "Join" not in text


def test_trades_are_kept_once_for_both_sides_of_a_difference(spark, monkeypatch):
    made, usual = [], FixtureTables._fact_trade
    monkeypatch.setattr(FixtureTables, "_fact_trade", lambda self, floor: made.append(floor) or usual(self, floor))
    text = plan(queries()["mv_refresh_diff"](spark, FOLDER))
    assert made == [None] and "l_shipdate" not in text


def test_refresh_keeps_trades_once(given, warehouse, monkeypatch):
    kept, usual = [], Kept.__init__
    monkeypatch.setattr(Kept, "__init__", lambda self, tables, fact, columns: kept.append(fact) or usual(self, tables, fact, columns))
    assert refresh.refresh(warehouse, "mv_trades_daily", given) == "SUCCESS"
    assert kept == ["fact_trade"]
    built = rollups.ROLLUPS["mv_trades_daily"].build(given.read("fact_trade"))
    assert sorted(map(str, dicts(warehouse.rollup("mv_trades_daily")))) == sorted(map(str, dicts(built)))


def test_sizes_of_rollups_need_no_sums_or_distinct_values(given):
    text = plan(refreshes.status(given, AS_OF))
    assert "l_suppkey" not in text and "p_retailprice" not in text and "o_totalprice" not in text
