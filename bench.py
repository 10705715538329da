"""

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Besides
the queries over the given tables, rollup reports are timed twice over a month-partitioned warehouse:
from the stored rollup (``*_stored``) and aggregated from the facts (``*_direct``).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame

from checks.queries import FACTS, queries
from tradewind.plans import dashboards, refresh, regions
from tradewind.session import build_session
from tradewind.sources.fixtures import AS_OF, FixtureTables
from tradewind.sources.tables import Tables
from tradewind.sources.warehouse import Warehouse, scratch_folder

HEADLINE = [
    "mv_trades_daily",
    "mv_issuance_daily",
    "mv_payments_daily",
    "mv_user_activity_daily",
    "trade_timeline",
    "comp_regional_breakdown",
    "comp_transaction_metrics",
    "regional_revenue_by_region",
    "regional_co2_by_region",
    "regional_transactions",
    "recent_trades",
    "recent_activities",
    "top_active_users",
    "kpi_snapshot",
    "dq_report",
    "logs_search",
    "ntf_unread_counts",
    "ntf_apply_reads",
    "ing_dedup_events",
    "ing_event_counters",
    "upsert_trade",
    "upsert_payment",
    "dim_users_fold",
    "mv_refresh_diff",
]


class DirectTables(Tables):
    """A warehouse whose rollups are aggregated from its facts at every read."""

    def __init__(self, warehouse: Warehouse):
        super().__init__(warehouse.spark)
        self.load = warehouse.load


def timed(build: Callable[[], DataFrame], runs: int = 2) -> float:
    """Best of ``runs``, all rows computed and thrown away."""
    best = float("inf")
    for _ in range(runs):
        start = time.monotonic()
        build().write.format("noop").mode("overwrite").save()
        best = min(best, time.monotonic() - start)
    return round(best, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry, results = queries(), {}
    for name in HEADLINE:
        results[name] = timed(lambda name=name: registry[name](spark, folder))

    given = FixtureTables(spark, folder)
    warehouse = Warehouse(spark, scratch_folder(spark, "bench"))
    start = time.monotonic()
    tx = warehouse.begin()
    for fact in FACTS:
        tx.replace(fact, given.read(fact))
    tx.replace("dim_users", given.read("dim_users"))
    tx.commit()
    results["warehouse_load"] = round(time.monotonic() - start, 3)
    start = time.monotonic()
    refresh.refresh_all(warehouse)
    results["refresh_all"] = round(time.monotonic() - start, 3)
    direct = DirectTables(warehouse)
    reports: dict[str, Callable[[Tables], DataFrame]] = {
        "trade_timeline": lambda t: dashboards.trade_timeline(t, AS_OF),
        "trade_series": lambda t: dashboards.trade_volume_series(t, AS_OF),
        "activity_by_type": lambda t: dashboards.activity_by_type(t, AS_OF),
        "revenue_metrics": lambda t: regions.revenue_metrics(t, AS_OF),
        "regional_breakdown": lambda t: regions.regional_breakdown(t, AS_OF),
    }
    for name, report in reports.items():
        results[f"{name}_stored"] = timed(lambda report=report: report(warehouse))
        results[f"{name}_direct"] = timed(lambda report=report: report(direct))
    total = round(sum(results.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": results}
    print(json.dumps({**line, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
