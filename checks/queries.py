"""One query per operator, each over the given tables (whole, at any scale)."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.functions.clock import days_back, moment
from tradewind.operators import dedup, logs, maintenance, notices, paging, refreshes, regional, rollups, upserts
from tradewind.operators import notifications as ntf
from tradewind.operators.paging import Page
from tradewind.plans import dashboards, health, refresh, regions
from tradewind.schemas import MONEY, TABLES, conform
from tradewind.session import prepare
from tradewind.sources import messages as msg
from tradewind.sources.fixture_messages import FixtureMessages
from tradewind.sources.fixtures import AS_OF, ORDER_SHIFT, FixtureTables
from tradewind.sources.kept import Kept
from tradewind.sources.warehouse import Warehouse, scratch_folder
from tradewind.streaming import intake, windows

Query = Callable[[SparkSession, str], DataFrame]
FACTS = ("fact_trade", "fact_payment", "fact_issuance", "fact_user_activity")

# The high-value threshold for the given tables, whose amounts stay below the usual one.
HIGH_VALUE = "50000"


def present(df: DataFrame) -> DataFrame:
    """Plain types for comparing: decimals as doubles to 6 places, timestamps without zone."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = F.round(c, 6).cast("double")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(f.name))
    return df.select(*columns)


_REGISTRY: dict[str, Query] = {}


def _add(name: str, build: Callable[[FixtureTables], DataFrame]) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return present(build(FixtureTables(prepare(spark), folder)))

    query.__name__ = name
    _REGISTRY[name] = query


def query(build: Callable[[FixtureTables], DataFrame]) -> Callable[[FixtureTables], DataFrame]:
    _add(build.__name__, build)
    return build


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- messages ---------------------------------------------------------------


def decoded(messages: DataFrame) -> DataFrame:
    return msg.decode(msg.route(messages))


def all_decoded(t: FixtureTables) -> DataFrame:
    return decoded(FixtureMessages(t).all())


def fresh(messages: DataFrame) -> DataFrame:
    """Usable events, each once."""
    return dedup.first_per_key(msg.usable(decoded(messages)), "event_id", F.struct("at", "stream", "value"))


def fresh_parts(t: FixtureTables, messages: DataFrame, *fields: str, text: Column | None = None) -> DataFrame:
    """Usable events, each once, with the fields asked for; ``text`` is what is left of the message's."""
    events = msg.trimmed(msg.usable(decoded(messages)), *fields).withColumn("left", F.lit(None).cast("string") if text is None else text)
    kept = events.select("event_id", "at", "stream", "value", "left", *msg.STREAMS)
    return dedup.first_by_text(kept, "event_id", ("at", "stream"), "value", f"{scratch_folder(t.spark, 'fresh')}/found").withColumnRenamed("left", "value")


@query
def src_route_events(t: FixtureTables) -> DataFrame:
    routed = msg.route(FixtureMessages(t).all())
    return routed.groupBy("stream", "routing_key").agg(F.count(F.lit(1)).alias("messages"))


def _parsed(t: FixtureTables, stream: str, messages: DataFrame) -> DataFrame:
    fields = [f.name for f in msg.MESSAGES[stream].fields if f.name not in (msg.CORRUPT, "version")]
    return decoded(messages).select(*(F.col(f"{stream}.{f}") for f in fields))


@query
def src_parse_user(t: FixtureTables) -> DataFrame:
    return _parsed(t, "user", FixtureMessages(t).users())


@query
def src_parse_trade(t: FixtureTables) -> DataFrame:
    return _parsed(t, "trade", FixtureMessages(t).trades())


@query
def src_parse_issuance(t: FixtureTables) -> DataFrame:
    return _parsed(t, "issuance", FixtureMessages(t).issuances())


@query
def src_parse_payment(t: FixtureTables) -> DataFrame:
    return _parsed(t, "payment", FixtureMessages(t).payments())


def _fact_warehouse(t: FixtureTables, name: str, facts: tuple[str, ...] = FACTS) -> Warehouse:
    """The given facts stored by month."""
    warehouse = Warehouse(t.spark, scratch_folder(t.spark, name))
    tx = warehouse.begin()
    for fact in facts:
        tx.replace(fact, t.read(fact))
    tx.commit()
    return warehouse


@query
def scan_fact_window(t: FixtureTables) -> DataFrame:
    """From facts stored by month; older months are not listed."""
    stored = _fact_warehouse(t, "window", ("fact_trade",))
    return stored.read("fact_trade", after=days_back(AS_OF, 30)).select("order_id", "executed_at", "amount")


@query
def sink_fact_by_month(t: FixtureTables) -> DataFrame:
    warehouse = _fact_warehouse(t, "facts")
    result = None
    for fact in FACTS:
        one = maintenance.months_present(warehouse, fact).select(
            F.lit(fact).alias("table_name"), "month", "row_count"
        )
        result = one if result is None else result.unionAll(one)
    return result


@query
def sink_dead_letter(t: FixtureTables) -> DataFrame:
    bad = all_decoded(t).filter(F.col("reason").isNotNull())
    return bad.select("routing_key", "stream", "reason", "event_id")


@query
def sink_payload_json(t: FixtureTables) -> DataFrame:
    """Whole events as JSON text, shown by reading fields back from the text, all in one go."""
    given = FixtureMessages(t)
    streams = {"payment": given.payments(), "trade": given.trades(), "user": given.users(), "issuance": given.issuances()}
    shown = {"trade": "orderStatus", "user": "action"}
    result = None
    for stream, messages in streams.items():
        events = decoded(messages).select("event_id", msg.payload(stream).alias("payload"))
        fields = ("correlationId", "paymentId", "amount", shown.get(stream, "status"), "timestamp", "errorMessage")
        read = F.json_tuple("payload", *fields).alias("correlation", "payment_id", "amount", "shown", "sent_at", "error_message")
        one = events.select("event_id", read).select(
            "event_id",
            F.lit(stream).alias("stream"),
            "correlation",
            "payment_id",
            F.col("amount").cast("decimal(18,6)").alias("amount"),
            "shown",
            F.col("sent_at").cast("timestamp").alias("sent_at"),
            "error_message",
        )
        result = one if result is None else result.unionAll(one)
    return result


# ---- intake -----------------------------------------------------------------


@query
def ing_dedup_events(t: FixtureTables) -> DataFrame:
    """A stream of deliveries, stopped after all but the last week and started again over all of them: what the second run lets through."""
    home = scratch_folder(t.spark, "deliveries")
    deliveries = t.read("event_deliveries")
    parts = (deliveries.filter(F.col("received_at") <= moment(days_back(AS_OF, 7))), deliveries)
    for n, part in enumerate(parts):
        part.write.parquet(f"{home}/inbox/{n}")
        stream = t.spark.readStream.schema(deliveries.schema).option("maxFilesPerTrigger", "4").parquet(f"{home}/inbox/*")

        def keep(batch: DataFrame, batch_id: int, n: int = n) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/run-{n}/{batch_id}")

        run = dedup.once(stream, "event_id").writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/progress")
        run.trigger(availableNow=True).start().awaitTermination()
    found = t.spark.read.schema(deliveries.schema).parquet(f"{home}/run-1/*")
    return found.select("event_id", "received_at", "event_type")


@query
def ing_mark_consumed(t: FixtureTables) -> DataFrame:
    """Events of all four streams."""
    ledger = notices.ledger_rows(fresh_parts(t, FixtureMessages(t).all(), "source"), AS_OF)
    return ledger.select("event_id", "event_type", "received_at")


@query
def ing_validate_ids(t: FixtureTables) -> DataFrame:
    trade = decoded(FixtureMessages(t).trades())
    return trade.select(
        "event_id",
        F.col("trade.buyerId").alias("buyer_text"),
        msg.strict_id(F.col("trade.buyerId")).alias("buyer_id"),
        msg.strict_id(F.col("trade.sellerId")).alias("seller_id"),
        "reason",
    )


@query
def ing_success_log(t: FixtureTables) -> DataFrame:
    fields = ("source", "correlationId", "userId", "buyerId", "payerId", "action", "orderStatus", "status")
    log = notices.success_logs(fresh_parts(t, FixtureMessages(t).all(), *fields), AS_OF)
    return log.select(
        "id", "log_level", "source_service", "category", "message", "correlation_id", "user_id", "log_timestamp"
    )


@query
def ing_error_log(t: FixtureTables) -> DataFrame:
    log = notices.error_logs(msg.dead_letters(all_decoded(t), moment(AS_OF)), AS_OF)
    return log.select("log_level", "source_service", "category", "message", "details", "log_timestamp")


@query
def ing_event_counters(t: FixtureTables) -> DataFrame:
    return notices.counters(all_decoded(t))


# ---- upserts ----------------------------------------------------------------


def _line_events(t: FixtureTables) -> DataFrame:
    """Line items as repeated events of one order: about four rows meet on every key."""
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        "*",
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(ORDER_SHIFT))).cast("timestamp").alias("at"),
        F.col("l_shipdate").cast("timestamp").alias("arrived_at"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
    )


def _in_two_loads(events: DataFrame, table: str, late) -> DataFrame:
    """Fold the early rows into an empty table, then the late ones into the result."""
    spec = TABLES[table]
    rows = events.select(*(c for c in events.columns if c in spec.columns), *upserts.ARRIVAL, late.alias("late"))
    missing = [F.lit(spec.defaults.get(c)).cast(spec.schema[c].dataType).alias(c) for c in spec.columns if c not in rows.columns]
    rows = rows.select("*", *missing)
    early = rows.filter(~F.col("late")).drop("late")
    stored = upserts.upsert(None, early, spec)
    return upserts.upsert(stored, rows.filter("late").drop("late"), spec)


@query
def upsert_trade(t: FixtureTables) -> DataFrame:
    events = _line_events(t).withColumns(
        {
            "order_id": F.col("l_orderkey").cast("string"),
            "buyer_id": F.col("o_custkey"),
            "seller_id": F.col("l_suppkey"),
            "quantity": F.col("l_quantity").cast("decimal(18,6)"),
            "unit_price": F.col("l_tax").cast("decimal(18,6)"),
            "amount": F.col("l_extendedprice").cast("decimal(18,6)"),
            "executed_at": F.col("at"),
            "region": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")),
            "order_status": F.col("l_linestatus"),
        }
    )
    return _in_two_loads(events, "fact_trade", F.col("l_linestatus") == "O")


@query
def upsert_payment(t: FixtureTables) -> DataFrame:
    events = _line_events(t).withColumns(
        {
            "payment_id": F.concat(F.lit("pay-"), F.col("l_orderkey").cast("string")),
            "order_id": F.col("l_partkey").cast("string"),
            "amount": F.col("l_extendedprice").cast("decimal(18,6)"),
            "currency": F.when(F.col("l_suppkey") % 2 == 0, "VND").otherwise("USD"),
            "status": F.col("l_returnflag"),
            "payment_method": F.when(F.col("l_suppkey") % 3 != 0, F.col("l_linestatus")),
            "completed_at": F.col("at"),
            "payer_id": F.col("l_suppkey").cast("string"),
            "region": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")),
        }
    )
    return _in_two_loads(events, "fact_payment", F.col("l_linestatus") == "O")


@query
def upsert_issuance(t: FixtureTables) -> DataFrame:
    """Events of a user on one day meet on one key."""
    events = t.raw("events").withColumns(
        {
            "issuance_id": F.coalesce(
                F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("iss-"), F.col("user_id").cast("string"))),
                F.concat(F.lit("req-"), F.col("user_id").cast("string")),
            ),
            "request_id": F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("req-"), F.col("event_id").cast("string"))),
            "quantity_tco2e": F.col("value").cast("decimal(18,6)"),
            "energy_kwh": F.when(F.col("event_id") % 5 != 0, F.col("value").cast("decimal(12,2)")),
            "issued_at": F.date_trunc("day", "ts"),
            "status": F.col("event_type"),
            "arrived_at": F.col("ts").cast("timestamp"),
            "event_id": F.col("event_id").cast("string"),
        }
    )
    late = ~F.col("event_type").isin("view", "signup")
    return _in_two_loads(events, "fact_issuance", late)


def _users_after(t: FixtureTables, *actions: str) -> DataFrame:
    events = msg.user_events(fresh(FixtureMessages(t).users()))
    if actions:
        events = events.filter(F.col("action").isin(*actions))
    return upserts.fold_users(t.read("dim_users"), events).drop("organization_name")


for _name, _actions in {
    "dim_users_fold": (),
    "dim_user_registered": ("REGISTERED",),
    "dim_user_logged_in": ("LOGGED_IN",),
    "dim_user_updated": ("UPDATED",),
    "dim_user_deleted": ("DELETED",),
    "dim_user_status": ("ENABLED", "DISABLED"),
}.items():
    _add(_name, lambda t, a=_actions: _users_after(t, *a))


@query
def activity_append(t: FixtureTables) -> DataFrame:
    events = msg.user_events(fresh(FixtureMessages(t).users()))
    rows = upserts.activities(events)
    sent = F.get_json_object("event_data", "$.eventId").alias("event_id")
    return rows.select("user_id", "event_type", "occurred_at", sent)


# ---- notification rules -----------------------------------------------------


def _raised(t: FixtureTables, messages: DataFrame, only: str | None = None) -> DataFrame:
    """Notices of fresh events, which come with what the rules look at and, of high-value trades' text, the amount as written."""
    fields = ("source", "action", "username", "role", "amount", "currency", "quantityTco2e", "userId", "status", "paymentId", "errorMessage", "payerId")
    amount = F.when(F.col("trade.amount") > F.lit(HIGH_VALUE).cast(MONEY), F.concat(F.lit('"amount":'), msg.as_written("amount")))
    return notices.notifications(fresh_parts(t, messages, *fields, text=amount), AS_OF, HIGH_VALUE, only)


def _notices(t: FixtureTables, messages: DataFrame, only: str | None) -> DataFrame:
    return _raised(t, messages, only).drop("target_service", "read_at")


@query
def ntf_user_registered(t: FixtureTables) -> DataFrame:
    return _notices(t, FixtureMessages(t).users(), "user_registered")


@query
def ntf_high_value_trade(t: FixtureTables) -> DataFrame:
    return _notices(t, FixtureMessages(t).trades(), "high_value_trade")


@query
def ntf_issuance_status(t: FixtureTables) -> DataFrame:
    return _notices(t, FixtureMessages(t).issuances(), "issuance")


@query
def ntf_payment_failed(t: FixtureTables) -> DataFrame:
    return _notices(t, FixtureMessages(t).payments(), "payment_failed")


@query
def ntf_create(t: FixtureTables) -> DataFrame:
    """All rules in one pass, beside one hand-made broadcast per error log row."""
    raised = _raised(t, FixtureMessages(t).all())
    log = t.read("system_logs").filter(F.col("log_level") == "ERROR").withColumn("event_id", F.col("id"))
    by_hand = notices.create(
        log,
        rule_name="by_hand",
        level="ERROR",
        title="Service error",
        message=F.col("details"),
        source=F.col("source_service"),
        now=AS_OF,
        category="SYSTEM",
    )
    return raised.unionByName(by_hand).drop("target_service", "read_at")


# ---- rollups ----------------------------------------------------------------

for _name in rollups.ROLLUPS:
    _add(_name, lambda t, n=_name: t.rollup(n))


def _ticking(start: datetime = AS_OF) -> Callable[[], datetime]:
    """A clock that moves one second per look, so that stored times do not depend on the machine."""
    looks = itertools.count()
    return lambda: start + timedelta(seconds=next(looks))


@query
def mv_refresh_one(t: FixtureTables) -> DataFrame:
    """Facts stored by month, rollup refreshed from them and read back."""
    warehouse = _fact_warehouse(t, "refresh", ("fact_payment",))
    refresh.refresh(warehouse, "mv_payments_daily", clock=_ticking())
    return warehouse.rollup("mv_payments_daily")


@query
def mv_refresh_all(t: FixtureTables) -> DataFrame:
    """The refresh log after refreshing all four."""
    warehouse = Warehouse(t.spark, scratch_folder(t.spark, "refresh-all"))
    refresh.refresh_all(warehouse, facts=t, clock=_ticking())
    return refresh.refresh_log(warehouse)


@query
def mv_refresh_diff(t: FixtureTables) -> DataFrame:
    """What changes when pending and last week's trades reach a rollup built without them, and when
    misdated payments that were never trades leave it."""
    kept = Kept(t, "fact_trade", ["buyer_id", "seller_id", "quantity", "unit_price", "amount", "executed_at", "order_status"])
    trades = kept.read("fact_trade")
    settled = trades.filter(
        (F.col("order_status") != "PENDING_PAYMENT") & (F.col("executed_at") <= moment(days_back(AS_OF, 7)))
    )
    stray = t.read("fact_payment").select(
        F.lit(0).cast("bigint").alias("buyer_id"),
        F.lit(0).cast("bigint").alias("seller_id"),
        F.lit(1).cast("decimal(18,6)").alias("quantity"),
        F.lit(1).cast("decimal(18,6)").alias("unit_price"),
        "amount",
        (F.col("completed_at") + F.make_dt_interval(F.lit(2000))).alias("executed_at"),
    )
    warehouse = Warehouse(t.spark, scratch_folder(t.spark, "difference"))
    tx = warehouse.begin()
    tx.replace("mv_trades_daily", rollups.trades_daily(settled.select(*stray.columns).unionByName(stray)))
    tx.commit()
    return refresh.refresh_by_difference(warehouse, "mv_trades_daily", kept)


@query
def mv_status(t: FixtureTables) -> DataFrame:
    return refreshes.status(t, AS_OF)


@query
def mv_refresh_history(t: FixtureTables) -> DataFrame:
    return refreshes.history(t)


@query
def mv_refresh_history_one(t: FixtureTables) -> DataFrame:
    return refreshes.history(t, "mv_issuance_daily", 20)


@query
def mv_refresh_stats(t: FixtureTables) -> DataFrame:
    return refreshes.stats(t, AS_OF, "mv_issuance_daily")


@query
def mv_vs_direct(t: FixtureTables) -> DataFrame:
    """A stored rollup beside the stored facts."""
    warehouse = _fact_warehouse(t, "direct", ("fact_trade",))
    refresh.refresh(warehouse, "mv_trades_daily", clock=_ticking())
    return refresh.compare_with_direct(warehouse, days_back(AS_OF, 30))


# ---- regional views ---------------------------------------------------------


@query
def v_regional_co2_stats(t: FixtureTables) -> DataFrame:
    regional.register_views(t, AS_OF)
    return t.spark.table("v_regional_co2_stats")


@query
def v_regional_trade_stats(t: FixtureTables) -> DataFrame:
    return regional.trade_stats(t, AS_OF)


@query
def v_regional_user_stats(t: FixtureTables) -> DataFrame:
    return regional.user_stats(t)


# ---- reports ----------------------------------------------------------------


def _filled(found: Page) -> DataFrame:
    if "log_level" in found.rows.columns:
        return found.rows.drop("message", "ip_address")
    return found.rows.drop("message", "source_service", "target_service", "read_at")


_REPORTS: dict[str, Callable[[FixtureTables], DataFrame]] = {
    "overview_counts": dashboards.overview_counts,
    "users_by_role": dashboards.users_by_role,
    "trade_volume_by_currency_all": dashboards.trade_volume_by_currency,
    "issuance_totals": dashboards.issuance_totals,
    "recent_activities": lambda t: dashboards.recent_activities(t, AS_OF),
    "users_by_region": dashboards.users_by_region,
    "recent_registrations": lambda t: dashboards.recent_registrations(t, AS_OF),
    "activity_by_type": lambda t: dashboards.activity_by_type(t, AS_OF),
    "activity_timeline": lambda t: dashboards.activity_timeline(t, AS_OF),
    "top_active_users": lambda t: dashboards.top_active_users(t, AS_OF),
    "trades_total_window": lambda t: dashboards.trades_total(t, AS_OF),
    "trade_volume_by_currency_90d": lambda t: dashboards.trade_volume_by_currency_recent(t, AS_OF),
    "recent_trades": dashboards.recent_trades,
    "trade_timeline": lambda t: dashboards.trade_timeline(t, AS_OF),
    "buyer_seller_stats": lambda t: dashboards.buyer_seller_stats(t, AS_OF),
    "issuance_window_totals": lambda t: dashboards.issuance_window_totals(t, AS_OF),
    "environmental_impact_90d": lambda t: dashboards.environmental_impact(t, AS_OF),
    "recent_issuances": dashboards.recent_issuances,
    "issuance_timeline": lambda t: dashboards.issuance_timeline(t, AS_OF),
    "issuance_unique_users": lambda t: dashboards.issuance_unique_users(t, AS_OF),
    "ts_user_registrations": lambda t: dashboards.user_registrations(t, AS_OF),
    "ts_trade_volume": lambda t: dashboards.trade_volume_series(t, AS_OF),
    "ts_carbon_issuance": lambda t: dashboards.issuance_series(t, AS_OF),
    "ts_event_processing": lambda t: dashboards.event_processing_series(t, AS_OF),
    "regional_co2_by_region": lambda t: regions.co2_by_region(t, AS_OF),
    "regional_co2_timeline": lambda t: regions.co2_timeline(t, AS_OF),
    "regional_revenue_by_region": lambda t: regions.revenue_by_region(t, AS_OF),
    "regional_revenue_timeline": lambda t: regions.revenue_timeline(t, AS_OF),
    "regional_transactions": lambda t: regions.transactions_by_region(t, AS_OF),
    "regional_users_by_role": regions.users_by_region_and_role,
    "regional_users_summary": regions.users_summary,
    "comp_co2_metrics": lambda t: regions.co2_metrics(t, AS_OF),
    "comp_revenue_metrics": lambda t: regions.revenue_metrics(t, AS_OF),
    "comp_transaction_metrics": lambda t: regions.transaction_metrics(t, AS_OF),
    "comp_user_metrics": regions.user_metrics,
    "comp_regional_breakdown": lambda t: regions.regional_breakdown(t, AS_OF),
    "perf_event_metrics": lambda t: regions.event_metrics(t, AS_OF),
    "perf_activity_metrics": lambda t: regions.activity_metrics(t, AS_OF),
    # logs and notifications, without the columns the given tables have nothing for
    "logs_search": lambda t: _filled(logs.search(t, AS_OF, level="ERROR", category="BUSINESS", source="svc-3")),
    "logs_errors": lambda t: _filled(logs.errors(t)),
    "logs_level_stats": lambda t: logs.level_counts(t, AS_OF),
    "logs_by_correlation": lambda t: _filled(logs.by_correlation(t, AS_OF, "c-42")),
    "logs_by_field": lambda t: _filled(logs.by_field(t, "source_service", "svc-1")),
    "ntf_for_user": lambda t: _filled(ntf.for_user(t, "42", unread_only=True)),
    "ntf_unread_counts": ntf.unread_counts,
    "ntf_by_level": lambda t: _filled(ntf.by_level(t, "WARNING")),
    "ntf_by_category": lambda t: _filled(ntf.by_category(t, "BUSINESS", number=1)),
    "ntf_stats_by_level": lambda t: ntf.counts_by_level(t, AS_OF),
    "ntf_by_id_or_target": lambda t: _filled(ntf.by_target(t, None, read=False)),
    # KPIs, health, data quality
    "kpi_snapshot": lambda t: health.kpi_snapshot(t, AS_OF),
    "kpi_summary": health.kpi_summary,
    "health_events": lambda t: health.event_counts(t, AS_OF),
    "health_latest_event": health.latest_event,
    "health_hourly": lambda t: health.events_per_hour(t, AS_OF),
    "dq_orphaned_activities": health.orphaned_activities,
    "dq_duplicate_events": lambda t: health.duplicate_events(t, "event_deliveries"),
    "dq_activity_coverage": health.activity_coverage,
    "dq_report": health.quality_report,
}
for _name, _build in _REPORTS.items():
    _add(_name, _build)


@query
def page(t: FixtureTables) -> DataFrame:
    """Third page of this week's log, reached from the last rows of the two before, with the number of all rows beside every row."""
    found = logs.search_on(t, AS_OF, size=25)
    for _ in range(2):
        found = logs.search_on(t, AS_OF, paging.last_of(found, "log_timestamp", "id"), size=25)
    return found.rows.select("id", "log_level", "log_timestamp", found.total.scalar().alias("total"))


@query
def ntf_apply_reads(t: FixtureTables) -> DataFrame:
    """Clicks are receipts for the notification before them, views mark everything of their user read."""
    events = t.raw("events")
    at = F.col("ts").cast("timestamp").alias("read_at")
    one = events.filter(F.col("event_type") == "click").select(
        F.concat(F.lit("n-"), (F.col("event_id") - 1).cast("string")).alias("notification_id"),
        F.lit(None).cast("string").alias("user_id"),
        at,
    )
    every = events.filter((F.col("event_type") == "view") & (F.col("user_id") % 3 == 0)).select(
        F.lit(None).cast("string").alias("notification_id"), F.col("user_id").cast("string").alias("user_id"), at
    )
    warehouse = _log_warehouse(t, "system_notifications")
    refresh.mark_read(warehouse, one.unionByName(every))
    return warehouse.read("system_notifications").select("notification_id", "target_user_id", "read_status", "read_at")


def _log_warehouse(t: FixtureTables, table: str) -> Warehouse:
    warehouse = Warehouse(t.spark, scratch_folder(t.spark, table))
    tx = warehouse.begin()
    tx.replace(table, t.read(table))
    tx.commit()
    return warehouse


# ---- maintenance ------------------------------------------------------------


@query
def mnt_purge_refresh_log(t: FixtureTables) -> DataFrame:
    warehouse = _log_warehouse(t, "mv_refresh_log")
    refresh.purge(warehouse, AS_OF, refresh_days=20)
    return warehouse.read("mv_refresh_log")


@query
def mnt_purge_notifications(t: FixtureTables) -> DataFrame:
    warehouse = _log_warehouse(t, "system_notifications")
    refresh.purge(warehouse, AS_OF)
    return warehouse.read("system_notifications").select("notification_id", "created_at", "expires_at")


@query
def mnt_retention_plan(t: FixtureTables) -> DataFrame:
    return maintenance.retention_plan(t, AS_OF)


@query
def mnt_partition_coverage(t: FixtureTables) -> DataFrame:
    """From the folders of stored facts."""
    stored = _fact_warehouse(t, "coverage", ("fact_trade", "fact_user_activity"))
    trades = maintenance.partition_coverage(stored, AS_OF, "fact_trade")
    return trades.unionAll(maintenance.partition_coverage(stored, AS_OF, "fact_user_activity"))


@query
def mnt_normalize_currency(t: FixtureTables) -> DataFrame:
    """Payments of suppliers' nations in old and new currencies, before and after."""
    lines = t.raw("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "R", "EUR").alias("currency"),
    )
    fixed = maintenance.normalize_currency(lines)
    return fixed.groupBy("currency").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_orderkey").alias("keys"))


@query
def mnt_conform_columns(t: FixtureTables) -> DataFrame:
    """Customers in the first layout of the user table: an ``org`` column, half of today's columns missing."""
    first_layout = t.raw("customer").select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("role"),
        F.concat(F.lit("org-"), F.col("c_nationkey").cast("string")).alias("org"),
    )
    return conform(first_layout, "dim_users").select(
        "user_id", "username", "role", "organization_name", "enabled"
    )


# ---- streaming --------------------------------------------------------------


@query
def stream_intake(t: FixtureTables) -> DataFrame:
    """All messages as a file stream in several micro-batches; what then is in each table."""
    home = scratch_folder(t.spark, "intake")
    inbox = f"{home}/inbox"
    FixtureMessages(t).all().write.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).json(inbox)
    warehouse = Warehouse(t.spark, f"{home}/store")
    stream = msg.message_stream(t.spark, inbox, maxFilesPerTrigger="6")
    run = intake.start(
        warehouse, stream, f"{home}/progress", clock=lambda: AS_OF, available_now=True, high_value=HIGH_VALUE
    )
    run.awaitTermination()
    result = None
    for table in (*FACTS, "dim_users", "consumed_events", "system_logs", "system_notifications", "dead_letters"):
        one = warehouse.read(table).agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        result = one if result is None else result.unionAll(one)
    return result


def _window_counts(t: FixtureTables, width: str) -> DataFrame:
    home = scratch_folder(t.spark, "windows")
    stream = (
        t.spark.readStream.schema(t.raw("events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(t.folder)
        .withColumn("received_at", F.col("ts").cast("timestamp"))
    )
    counts = windows.event_counts(stream, "received_at", width)
    windows.keep_counts(counts, f"{home}/counts", f"{home}/progress").awaitTermination()
    return windows.read_counts(t.spark, f"{home}/counts")


@query
def stream_events_daily(t: FixtureTables) -> DataFrame:
    return _window_counts(t, "1 day")


@query
def stream_events_hourly(t: FixtureTables) -> DataFrame:
    return _window_counts(t, "1 hour")


@query
def stream_events_bounded(t: FixtureTables) -> DataFrame:
    """Events by hour with three hours' patience, errors delivered after everything else: what the windows kept, and what came too late."""
    home = scratch_folder(t.spark, "bounded")
    events = t.raw("events").select(F.col("ts").cast("timestamp").alias("received_at"), "event_type")
    for n, part in enumerate((events.filter("event_type <> 'error'"), events.filter("event_type = 'error'"))):
        part.coalesce(1).write.parquet(f"{home}/inbox/{n}")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{home}/inbox/*")
        counts = windows.event_counts(stream, "received_at", "1 hour", "3 hours")
        windows.keep_counts(counts, f"{home}/counts", f"{home}/progress").awaitTermination()
    kept = windows.read_counts(t.spark, f"{home}/counts")
    late = windows.late_events(t.spark.read.parquet(f"{home}/inbox/*"), kept, "received_at", "1 hour")
    both = kept.join(late, "start", "full_outer")
    return both.select("start", F.coalesce("count", F.lit(0)).alias("kept"), F.coalesce("missing", F.lit(0)).alias("late"))
