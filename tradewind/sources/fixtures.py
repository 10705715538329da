"""The given Parquet tables seen as the star schema.

``lineitem`` rows play trades, ``orders`` payments, ``events`` issuances, activities, ledger, logs and
notifications, ``customer`` users. Dates are moved so that all facts end on 2024-01-30. A time bound is
turned round to the source column, so it reaches the Parquet scan instead of staying on a shifted date.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import ROLLUPS
from ..schemas import MEASURE, MONEY, TABLES, conform
from .kept import Kept
from .tables import Tables

AS_OF = datetime(2024, 1, 30, 18, 0, 0)
TRADE_SHIFT = 8122
ORDER_SHIFT = 8217


def _shifted(column: str, days: int) -> Column:
    return (F.col(column) + F.make_dt_interval(F.lit(days))).cast("timestamp")


def _late_enough(df: DataFrame, column: str, floor: datetime | None, shift: int = 0) -> DataFrame:
    if floor is None:
        return df
    bound = (floor - timedelta(days=shift)).isoformat(sep=" ")
    return df.filter(F.col(column) >= F.expr(f"TIMESTAMP_NTZ '{bound}'"))


def _number(column: str, kind: str) -> Column:
    return F.col(column).cast(kind)


class FixtureTables(Tables):
    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def load(self, name: str, floor: datetime | None = None) -> DataFrame:
        maker = getattr(self, f"_{name}", None)
        if maker is not None:
            df = maker(floor)
        elif name in TABLES:
            raise KeyError(f"the given tables hold nothing for {name}")
        else:
            raise KeyError(name)
        return conform(df, name) if name in TABLES else df

    def facts_of(self, name: str) -> DataFrame:
        """Trades join three large tables: they are put together once, not once for each aggregation."""
        spec = ROLLUPS[name]
        if spec.fact != "fact_trade":
            return super().facts_of(name)
        return Kept(self, spec.fact, spec.columns).read(spec.fact)

    # -- dimensions

    def _placed(self, rows: DataFrame, customer: str) -> DataFrame:
        """Adds the customer's columns and ``region``, null for every seventh nation.

        The base tables are joined one by one to the rows: a filter on the rows shrinks every later
        shuffle, and each right side is a plain table whose size Spark knows, so it picks the join well.
        """
        return self._region_of(rows.join(self.raw("customer"), F.col(customer) == F.col("c_custkey")))

    def _region_of(self, customers: DataFrame) -> DataFrame:
        return (
            customers.join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("region", F.when(F.col("n_nationkey") % 7 != 0, F.col("r_name")))
        )

    def _dim_users(self, floor: datetime | None) -> DataFrame:
        first_order = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
        known = self._region_of(self.raw("customer"))
        return known.join(first_order, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("username"),
            F.col("c_mktsegment").alias("role"),
            "region",
            _shifted("first_order", ORDER_SHIFT).alias("created_at"),
            (F.col("c_custkey") % 11 != 0).alias("enabled"),
        )

    # -- facts

    def _fact_trade(self, floor: datetime | None) -> DataFrame:
        lines = _late_enough(self.raw("lineitem"), "l_shipdate", floor, TRADE_SHIFT)
        status = (
            F.when(F.col("o_orderstatus") == "F", "COMPLETED")
            .when(F.col("o_orderstatus") == "O", "CREATED")
            .otherwise("PENDING_PAYMENT")
        )
        auction = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
        of_order = F.col("l_orderkey") == F.col("o_orderkey")
        if floor is None:
            # All lines are needed: a customer is looked up for each order, not for each of its lines.
            sold = lines.join(self._placed(self.raw("orders"), "o_custkey"), of_order)
        else:
            sold = self._placed(lines.join(self.raw("orders"), of_order), "o_custkey")
        return (
            sold.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"),
                F.col("o_custkey").alias("buyer_id"),
                F.col("l_suppkey").alias("seller_id"),
                F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey").cast("string")).alias("listing_id"),
                _number("l_quantity", MONEY).alias("quantity"),
                _number("p_retailprice", MONEY).alias("unit_price"),
                _number("l_extendedprice", MONEY).alias("amount"),
                _shifted("l_shipdate", TRADE_SHIFT).alias("executed_at"),
                "region",
                status.alias("order_status"),
                auction.alias("is_auction"),
            )
        )

    def _fact_payment(self, floor: datetime | None) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "COMPLETED")
            .when(F.col("o_orderstatus") == "O", "PENDING")
            .otherwise("FAILED")
        )
        return _late_enough(self.raw("orders"), "o_orderdate", floor, ORDER_SHIFT).select(
            F.col("o_orderkey").alias("payment_id"),
            F.col("o_orderkey").alias("order_id"),
            _number("o_totalprice", MONEY).alias("amount"),
            status.alias("status"),
            F.col("o_orderpriority").alias("payment_method"),
            _shifted("o_orderdate", ORDER_SHIFT).alias("completed_at"),
            F.col("o_custkey").alias("payer_id"),
        )

    def _events(self, floor: datetime | None) -> DataFrame:
        return _late_enough(self.raw("events"), "ts", floor)

    def _fact_issuance(self, floor: datetime | None) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "purchase", "APPROVED")
            .when(F.col("event_type") == "view", "PENDING")
            .otherwise("REJECTED")
        )
        events = self._events(floor).filter(F.col("event_type").isin("purchase", "view", "error"))
        return self._placed(events, "user_id").select(
            F.col("event_id").alias("issuance_id"),
            "user_id",
            F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
            _number("value", MONEY).alias("quantity_tco2e"),
            F.get_json_object("props", "$.k").cast(MEASURE).alias("distance_km"),
            F.when(F.col("event_id") % 5 != 0, _number("value", MEASURE)).alias("energy_kwh"),
            _number("user_id", MEASURE).alias("co2_avoided_kg"),
            F.col("ts").alias("issued_at"),
            "region",
            status.alias("status"),
        )

    def _fact_user_activity(self, floor: datetime | None) -> DataFrame:
        # Some activities are those of users that no table knows.
        user = F.when(F.col("user_id") % 20 == 19, -F.col("user_id")).otherwise(F.col("user_id"))
        return self._events(floor).select(
            user.alias("user_id"), "event_type", F.col("props").alias("event_data"), F.col("ts").alias("occurred_at")
        )

    # -- ledger, logs, notifications, refresh log

    def _consumed_events(self, floor: datetime | None) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "signup", "USER_EVENT")
            .when(F.col("event_type") == "purchase", "TRADE_EVENT")
            .when(F.col("event_type") == "view", "ISSUANCE_EVENT")
            .when(F.col("event_type") == "click", "PAYMENT_EVENT")
        )
        return self._events(floor).select(
            "event_id",
            F.col("ts").alias("received_at"),
            kind.alias("event_type"),
            F.col("props").alias("payload"),
        )

    def _event_deliveries(self, floor: datetime | None) -> DataFrame:
        """The ledger's events as delivered: every fiftieth arrives twice."""
        once = conform(self._consumed_events(floor), "consumed_events")
        return once.unionAll(once.filter(F.col("event_id").cast("bigint") % 50 == 0))

    def _system_logs(self, floor: datetime | None) -> DataFrame:
        level = (
            F.when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "view", "DEBUG")
            .when(F.col("event_type") == "click", "WARN")
            .otherwise("INFO")
        )
        return self._events(floor).select(
            F.col("event_id").alias("id"),
            level.alias("log_level"),
            F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("source_service"),
            F.when(F.col("event_id") % 2 == 0, "BUSINESS").otherwise("SYSTEM").alias("category"),
            F.col("props").alias("details"),
            F.concat(F.lit("c-"), (F.col("event_id") % 97).cast("string")).alias("correlation_id"),
            "user_id",
            F.col("ts").alias("log_timestamp"),
        )

    def _system_notifications(self, floor: datetime | None) -> DataFrame:
        lives = F.make_dt_interval(F.lit(0), F.lit(72))
        return (
            self._events(floor)
            .filter(F.col("event_type").isin("error", "signup"))
            .select(
                F.concat(F.lit("n-"), F.col("event_id").cast("string")).alias("notification_id"),
                F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO").alias("level"),
                F.when(F.col("event_id") % 2 == 0, "BUSINESS").otherwise("SYSTEM").alias("category"),
                F.col("event_type").alias("title"),
                F.when(F.col("event_id") % 10 != 0, F.col("user_id").cast("string")).alias("target_user_id"),
                (F.col("event_id") % 3 == 0).alias("read_status"),
                F.col("ts").alias("created_at"),
                F.when(F.col("event_id") % 4 != 0, F.col("ts") + lives).alias("expires_at"),
            )
        )

    def _mv_refresh_log(self, floor: datetime | None) -> DataFrame:
        """Events seen as refresh runs of the four rollups: views still run, errors failed."""
        running = F.col("event_type") == "view"
        failed = F.col("event_type") == "error"
        name = (
            F.when(F.col("event_id") % 4 == 0, "mv_trades_daily")
            .when(F.col("event_id") % 4 == 1, "mv_issuance_daily")
            .when(F.col("event_id") % 4 == 2, "mv_payments_daily")
            .otherwise("mv_user_activity_daily")
        )
        took = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id") % 900)
        return self._events(floor).select(
            name.alias("mv_name"),
            F.col("ts").alias("refresh_started_at"),
            F.when(~running, F.col("ts") + took).alias("refresh_completed_at"),
            F.when(running, "RUNNING").when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
            F.when(failed, F.concat(F.lit("failed on "), F.col("props"))).alias("error_message"),
            F.when(~running & ~failed, F.col("event_id") % 1000).alias("rows_affected"),
        )
