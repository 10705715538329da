"""The given Parquet tables seen as broker messages: routing key and JSON text.

Every row becomes an event. Some carry bad ids, lack a time or a status; suppliers become broken JSON,
customers go out under an unbound routing key, and every fiftieth event is delivered twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixtures import ORDER_SHIFT, TRADE_SHIFT, FixtureTables, _shifted
from .messages import WIRE_TIME


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _uuid(high: str, low: str) -> Column:
    """Two numbers written in the form of a UUID."""
    return F.concat(
        F.lit("00000000-0000-0000-"), F.lpad(_text(high), 4, "0"), F.lit("-"), F.lpad(_text(low), 12, "0")
    )


def _message(df: DataFrame, routing_key: Column, again: Column, **fields: Column) -> DataFrame:
    body = F.struct(*(value.alias(name) for name, value in fields.items()))
    times = F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    made = df.select(
        routing_key.alias("routing_key"),
        F.to_json(body, {"timestampFormat": WIRE_TIME}).alias("value"),
        times.alias("times"),
    )
    return made.withColumn("copy", F.explode("times")).select("routing_key", "value")


class FixtureMessages:
    def __init__(self, tables: FixtureTables):
        self.tables = tables

    def trades(self) -> DataFrame:
        """Line items as trade events of their order, at the order's date and line number."""
        t = self.tables
        lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        status = F.col("o_orderstatus")
        buyer = (
            F.when(F.col("l_partkey") % 40 == 0, F.concat(F.lit("x"), _text("o_custkey")))
            .when(F.col("l_partkey") % 40 == 1, "")
            .when(F.col("l_partkey") % 40 != 2, _text("o_custkey"))
        )
        return _message(
            lines,
            F.when(status == "F", "marketplace.trade.completed")
            .when(status == "O", "marketplace.trade.created")
            .otherwise("marketplace.trade.updated"),
            F.col("l_partkey") % 50 == 0,
            eventId=F.concat_ws(
                "-",
                F.lit("t"),
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.date_format("l_shipdate", "yyyyMMdd"),
            ),
            eventType=F.lit("TRADE"),
            source=F.lit("marketplace-service"),
            timestamp=_shifted("l_shipdate", TRADE_SHIFT),
            correlationId=F.concat(F.lit("c-"), _text("l_orderkey")),
            userId=_text("o_custkey"),
            orderId=_uuid("l_linenumber", "l_orderkey"),
            listingId=F.when(F.col("l_partkey") % 10 != 0, _uuid("l_linenumber", "l_partkey")),
            buyerId=buyer,
            sellerId=_text("l_suppkey"),
            quantity=F.col("l_quantity").cast("decimal(18,2)"),
            quantityUnit=F.when(F.col("l_suppkey") % 2 == 0, "kgCO2e"),
            unitPrice=F.col("l_tax").cast("decimal(18,2)"),
            amount=F.col("l_extendedprice").cast("decimal(18,2)"),
            currency=F.when(F.col("l_suppkey") % 9 != 0, "VND"),
            orderStatus=F.when(status == "F", "completed").when(status == "P", "PENDING_PAYMENT").otherwise("CREATED"),
            statusChangedAt=F.when(F.col("l_suppkey") % 3 != 0, _shifted("o_orderdate", ORDER_SHIFT)),
            isAuction=F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False),
        )

    def payments(self) -> DataFrame:
        """Orders as payment events; some open ones carry no time at all."""
        status, at = F.col("o_orderstatus"), _shifted("o_orderdate", ORDER_SHIFT)
        return _message(
            self.tables.raw("orders"),
            F.when(status == "F", "payment.payment.success")
            .when(status == "O", "payment.payment.created")
            .otherwise("payment.payment.failed"),
            F.col("o_orderkey") % 50 == 0,
            eventId=F.concat(F.lit("p-"), _text("o_orderkey")),
            eventType=F.lit("PAYMENT"),
            source=F.lit("payment-service"),
            timestamp=at,
            correlationId=F.concat(F.lit("c-"), _text("o_orderkey")),
            userId=_text("o_custkey"),
            paymentId=F.concat(F.lit("pay-"), _text("o_orderkey")),
            orderId=_text("o_orderkey"),
            payerId=_text("o_custkey"),
            amount=F.col("o_totalprice").cast("decimal(18,2)"),
            currency=F.lit("VND"),
            status=F.when(status == "F", "completed")
            .when(status == "O", "PENDING")
            .when(F.col("o_orderkey") % 3 == 0, "failed")
            .otherwise("FAILED"),
            paymentMethod=F.col("o_orderpriority"),
            initiatedAt=F.when((status == "O") & (F.col("o_orderkey") % 7 != 0), at),
            completedAt=F.when(status == "F", at),
            failedAt=F.when(status == "P", at),
            errorMessage=F.when(F.col("o_orderkey") % 2 == 0, "card declined"),
        )

    def users(self) -> DataFrame:
        """Events as user events; a purchase switches its user on or off."""
        kind, n = F.col("event_type"), F.col("event_id")
        action = (
            F.when(kind == "signup", "REGISTERED")
            .when(kind == "click", "LOGGED_IN")
            .when(kind == "view", "UPDATED")
            .when(kind == "error", "DELETED")
            .when(n % 3 == 0, "ENABLED")
            .when(n % 3 == 1, "DISABLED")
            .when(n % 5 != 0, "ARCHIVED")
        )
        told = (kind == "signup") | ((kind == "view") & (n % 2 == 1))
        return _message(
            self.tables.raw("events"),
            F.when(kind == "signup", "auth.user.registered")
            .when(kind == "click", "auth.user.loggedin")
            .when(kind == "error", "auth.user.deleted")
            .otherwise("auth.user.updated"),
            n % 50 == 0,
            eventId=F.concat(F.lit("u-"), _text("event_id")),
            eventType=F.lit("USER"),
            source=F.lit("auth-service"),
            timestamp=F.col("ts").cast("timestamp"),
            correlationId=F.concat(F.lit("c-"), (n % 97).cast("string")),
            userId=F.when(n % 31 == 0, F.concat(F.lit("u"), _text("user_id"))).otherwise(_text("user_id")),
            username=F.when(told, F.concat(F.lit("user-"), _text("event_id"))),
            email=F.when(told & (n % 4 != 0), F.concat(_text("event_id"), F.lit("@example.org"))),
            role=F.when(
                (kind == "signup") | ((kind == "view") & (n % 3 == 0)), F.concat(F.lit("role-"), (n % 4).cast("string"))
            ),
            region=F.when(told & (n % 7 != 0), F.concat(F.lit("region-"), (n % 5).cast("string"))),
            enabled=F.when(n % 4 == 0, True).when(n % 4 == 1, False),
            action=action,
            phoneNumber=F.when(n % 6 == 0, _text("event_id")),
        )

    def issuances(self) -> DataFrame:
        """Purchases, views and errors as issuance events; only approved ones have an issuance id."""
        kind, n = F.col("event_type"), F.col("event_id")
        events = self.tables.raw("events").filter(kind.isin("purchase", "view", "error"))
        return _message(
            events,
            F.when(kind == "purchase", "carbon.credit.issued")
            .when(kind == "view", "carbon.credit.requested")
            .otherwise("carbon.credit.rejected"),
            n % 50 == 0,
            eventId=F.concat(F.lit("i-"), _text("event_id")),
            eventType=F.lit("ISSUANCE"),
            source=F.lit("carbon-service"),
            timestamp=F.col("ts").cast("timestamp"),
            correlationId=F.concat(F.lit("c-"), (n % 97).cast("string")),
            userId=_text("user_id"),
            issuanceId=F.when(kind == "purchase", F.concat(F.lit("iss-"), _text("event_id"))),
            requestId=F.concat(F.lit("req-"), _text("event_id")),
            vehicleId=F.concat(F.lit("v-"), (n % 13).cast("string")),
            quantityTco2e=F.col("value").cast("decimal(18,6)"),
            distanceKm=F.get_json_object("props", "$.k").cast("decimal(12,2)"),
            energyKwh=F.when(n % 5 != 0, F.col("value").cast("decimal(12,2)")),
            co2AvoidedKg=F.col("user_id").cast("decimal(12,2)"),
            status=F.when(n % 100 == 99, None)
            .when(kind == "purchase", "APPROVED")
            .when(kind == "view", "PENDING")
            .otherwise("REJECTED"),
        )

    def broken(self) -> DataFrame:
        """Suppliers as JSON cut off in the middle."""
        return self.tables.raw("supplier").select(
            F.lit("auth.user.updated").alias("routing_key"),
            F.concat(F.lit('{"eventId": "b-'), _text("s_suppkey"), F.lit('", "source": ')).alias("value"),
        )

    def unbound(self) -> DataFrame:
        """Customers as messages nobody listens to."""
        return self.tables.raw("customer").select(
            F.lit("auth.user.banned").alias("routing_key"),
            F.concat(F.lit('{"eventId": "x-'), _text("c_custkey"), F.lit('"}')).alias("value"),
        )

    def all(self) -> DataFrame:
        parts = [self.trades(), self.payments(), self.users(), self.issuances(), self.broken(), self.unbound()]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionAll(part)
        return result
