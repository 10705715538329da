"""Rollups kept by adding up states, and the gauges that read them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import AS_OF, dicts, frame
from tradewind.operators import rollups
from tradewind.plans import dashboards, health, refresh
from tradewind.sources.tables import Tables
from tradewind.sources.warehouse import Warehouse

FACTS = ("fact_trade", "fact_issuance", "fact_payment", "fact_user_activity")


def some(spark, table, rng, n, first=datetime(2023, 10, 1), days=120):
    def at():
        return first + timedelta(days=rng.randrange(days), hours=rng.randrange(24))

    def maybe(x):
        return None if rng.random() < 0.1 else x

    rows = {
        "fact_trade": lambda i: {"order_id": str(i), "buyer_id": maybe(rng.randrange(6)), "seller_id": rng.randrange(2**40), "quantity": maybe(rng.randrange(9)),
                                 "unit_price": maybe(rng.randrange(99) / 7), "amount": rng.randrange(999), "currency": maybe(rng.choice(["VND", "EUR"])), "executed_at": at()},
        "fact_issuance": lambda i: {"issuance_id": str(i), "user_id": maybe(rng.randrange(6)), "quantity_tco2e": maybe(rng.randrange(9)), "issued_at": at()},
        "fact_payment": lambda i: {"payment_id": str(i), "amount": maybe(rng.randrange(9)), "status": rng.choice(["COMPLETED", "FAILED"]), "payment_method": maybe(rng.choice("abc")), "completed_at": at()},
        "fact_user_activity": lambda i: {"user_id": maybe(rng.randrange(6)), "event_type": maybe(rng.choice("xyz")), "occurred_at": at()},
    }
    return frame(spark, table, [rows[table](rng.random()) for _ in range(n)])


def add(warehouse, table, df):
    tx = warehouse.begin()
    tx.append(table, df)
    tx.commit()


def rows(df):
    return sorted(map(str, dicts(df)))


def same_as_built(warehouse, facts=FACTS):
    for name, spec in ((n, r) for n, r in rollups.ROLLUPS.items() if r.fact in facts):
        assert rows(warehouse.rollup(name)) == rows(spec.build(warehouse.read(spec.fact)).select(*warehouse.rollup(name).columns)), name


def reads(monkeypatch, *tables):
    """Folders of these tables that are read from here on."""
    found, usual = [], Warehouse.folders_as_table

    def spied(self, name, folders):
        found.extend(f for f in folders if name in tables)
        return usual(self, name, folders)

    monkeypatch.setattr(Warehouse, "folders_as_table", spied)
    return found


def test_states_follow_late_replaced_and_deleted_rows(spark, warehouse):
    rng = random.Random(1)
    tx = warehouse.begin()
    for fact in FACTS:
        tx.append(fact, some(spark, fact, rng, 80, days=80))
    tx.commit()
    assert set(refresh.refresh_all(warehouse).values()) == {"SUCCESS"}
    same_as_built(warehouse)
    tx = warehouse.begin()
    some_facts = ("fact_trade", "fact_payment")
    for fact in some_facts:  # late rows of days and values there are, and of new ones; rows leave: a folder is written again without some, a month goes
        tx.append(fact, some(spark, fact, rng, 15, days=100))
        folder = tx.base.folders(fact)[1]
        tx.replace_folders(fact, [folder], warehouse.folders_as_table(fact, [folder]).sample(0.5, seed=3))
        tx.drop_months(fact, ["2023-12"])
    tx.commit()
    for name in ("mv_trades_daily", "mv_payments_daily"):
        refresh.refresh(warehouse, name)
    same_as_built(warehouse, some_facts)
    refresh.compact(warehouse, least=2)  # other folders, same rows
    assert all(len(f) == 1 for f in warehouse.state().tables["mv_trades_daily_state"].values())
    refresh.refresh(warehouse, "mv_trades_daily")
    same_as_built(warehouse, ["fact_trade"])


def test_a_refresh_reads_new_folders_only(spark, warehouse, monkeypatch):
    rng = random.Random(2)
    add(warehouse, "fact_trade", some(spark, "fact_trade", rng, 60))
    refresh.refresh(warehouse, "mv_trades_daily")
    before = set(warehouse.state().folders("fact_trade"))
    add(warehouse, "fact_trade", some(spark, "fact_trade", rng, 1))
    found = reads(monkeypatch, "fact_trade")
    refresh.refresh(warehouse, "mv_trades_daily")
    (new,) = set(warehouse.state().folders("fact_trade")) - before
    assert set(found) == {new}
    refresh.refresh(warehouse, "mv_trades_daily")
    assert set(found) == {new}  # nothing came, nothing is read


def test_folders_that_vacuum_took_start_the_state_anew(spark, warehouse):
    rng = random.Random(3)
    add(warehouse, "fact_issuance", some(spark, "fact_issuance", rng, 30, days=20))
    refresh.refresh(warehouse, "mv_issuance_daily")
    (folder,) = warehouse.state().folders("fact_issuance")
    tx = warehouse.begin()
    tx.replace_folders("fact_issuance", [folder], warehouse.folders_as_table("fact_issuance", [folder]).limit(7))
    tx.commit()
    warehouse.files.drop(f"{warehouse.root}/{folder}")
    assert refresh.refresh(warehouse, "mv_issuance_daily") == "SUCCESS"
    same_as_built(warehouse, ["fact_issuance"])


def test_other_ways_of_refreshing_leave_no_stale_state(spark, warehouse, memory):
    rng = random.Random(4)
    add(warehouse, "fact_trade", some(spark, "fact_trade", rng, 20))
    refresh.refresh(warehouse, "mv_trades_daily")
    elsewhere = memory(fact_trade=[])
    refresh.refresh(warehouse, "mv_trades_daily", facts=elsewhere)
    assert warehouse.rollup("mv_trades_daily").count() == 0
    refresh.refresh(warehouse, "mv_trades_daily")
    same_as_built(warehouse, ["fact_trade"])
    refresh.refresh_by_difference(warehouse, "mv_trades_daily", elsewhere)
    assert warehouse.rollup("mv_trades_daily").count() == 0
    refresh.refresh(warehouse, "mv_trades_daily")
    same_as_built(warehouse, ["fact_trade"])


@pytest.mark.parametrize("name", rollups.ROLLUPS)
def test_no_row_is_expanded(spark, name):
    spec = rollups.ROLLUPS[name]
    text = spec.build(frame(spark, spec.fact, []))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in text


def test_literal_trades(spark):
    day = {"quantity": 1, "executed_at": "2024-01-05 01:00:00", "buyer_id": 1}
    facts = frame(
        spark,
        "fact_trade",
        [
            {**day, "seller_id": 7, "amount": 3, "unit_price": 1},
            {**day, "seller_id": 8, "amount": 4, "unit_price": 2},
            {**day, "seller_id": None, "amount": None, "unit_price": None},
            {"executed_at": "2024-01-06 00:00:00"},
            {"executed_at": None, "amount": 5},
        ],
    )
    found = {str(r["day"])[:10]: tuple(None if v is None else float(v) for k, v in r.items() if k != "day") for r in dicts(rollups.trades_daily(facts))}
    assert found == {"2024-01-05": (3, 7, 3, 1.5, 1, 2), "2024-01-06": (None, None, 1, None, 0, 0), "None": (None, 5, 1, None, 0, 0)}


@pytest.mark.parametrize("name", rollups.ROLLUPS)
def test_size_is_the_number_of_rows_built(spark, name):
    spec = rollups.ROLLUPS[name]
    facts = some(spark, spec.fact, random.Random(6), 40)
    undated = some(spark, spec.fact, random.Random(7), 9).withColumn(spec.time, F.lit(None).cast("timestamp"))
    for given in (facts.limit(0), facts, facts.unionByName(undated)):
        assert dicts(spec.size(given)) == [{"n": spec.build(given).count()}]


def gauges(tables):
    return [dicts(health.kpi_snapshot(tables, AS_OF)), dicts(health.kpi_summary(tables)), dicts(dashboards.overview_counts(tables)), dicts(dashboards.issuance_totals(tables))]


class Scanned(Tables):
    """The same rows without any shortcut."""

    def __init__(self, warehouse):
        super().__init__(warehouse.spark)
        self.load = warehouse.load


def test_gauges_come_from_rollups_and_what_came_since(spark, warehouse, monkeypatch):
    rng = random.Random(5)
    assert gauges(warehouse) == gauges(Scanned(warehouse))  # nothing at all
    for fact in FACTS:
        add(warehouse, fact, some(spark, fact, rng, 40))
    events = frame(spark, "consumed_events", [{"event_id": str(i), "received_at": AS_OF} for i in range(9)])
    add(warehouse, "consumed_events", events)
    assert gauges(warehouse) == gauges(Scanned(warehouse))  # before any refresh
    for name in ("mv_trades_daily", "mv_issuance_daily"):
        refresh.refresh(warehouse, name)
    old = {f for fact in FACTS for f in warehouse.state().folders(fact)}
    tx = warehouse.begin()
    for fact in FACTS[:2]:
        tx.append(fact, some(spark, fact, rng, 5))
    folder = tx.base.folders("fact_trade")[0]
    tx.replace_folders("fact_trade", [folder], warehouse.folders_as_table("fact_trade", [folder]).limit(1))
    tx.commit()
    wanted = gauges(Scanned(warehouse))
    tx = warehouse.begin()  # and a month goes
    (gone,) = warehouse.state().tables["fact_issuance"]["2023-11"][:1]
    tx.drop_months("fact_issuance", ["2023-11"])
    tx.commit()
    assert wanted != (wanted := gauges(Scanned(warehouse)))
    found = reads(monkeypatch, "fact_trade", "fact_issuance")
    assert gauges(warehouse) == wanted
    assert found and gone not in found and set(found) & old == {folder}  # the one that was replaced; no other old folder


def test_counts_come_from_footers(spark, warehouse):
    events = frame(spark, "consumed_events", [{"event_id": str(i), "received_at": f"2023-{i + 1:02}-01 00:00:00"} for i in range(9)])
    add(warehouse, "consumed_events", events)
    counted = warehouse.size("consumed_events")
    assert dicts(counted) == [{"n": 9}]
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().executedPlan().toString()


def test_months_come_from_folder_names(spark, warehouse, monkeypatch):
    add(warehouse, "fact_trade", frame(spark, "fact_trade", [{"order_id": str(i), "executed_at": t} for i, t in enumerate(["2023-10-05 00:00:00", "2023-12-05 00:00:00", None])]))
    from tradewind.operators import maintenance

    found = reads(monkeypatch, "fact_trade")
    missing = maintenance.partition_coverage(warehouse, AS_OF, "fact_trade")
    assert [r["missing_month"] for r in dicts(missing)] == ["2023-11", "2024-01", "2024-02"]
    assert not found and not any("fact_trade" in f for f in missing.inputFiles())


def test_stored_dollars_read_as_dong(spark, warehouse):
    add(warehouse, "fact_payment", frame(spark, "fact_payment", [{"payment_id": c or "-", "currency": c, "completed_at": AS_OF} for c in ("USD", "EUR", None, "VND")]))
    assert {r["payment_id"]: r["currency"] for r in dicts(warehouse.read("fact_payment"))} == {"USD": "VND", "EUR": "EUR", "-": None, "VND": "VND"}
