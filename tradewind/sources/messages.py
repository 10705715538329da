"""Messages: routing key + JSON text -> typed events, and the ones that cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CORRUPT, MESSAGES

# Routing keys each stream is bound to.
BINDINGS: dict[str, tuple[str, ...]] = {
    "user": (
        "auth.user.registered",
        "auth.user.loggedin",
        "auth.user.updated",
        "auth.user.deleted",
    ),
    "trade": (
        "marketplace.trade.created",
        "marketplace.trade.updated",
        "marketplace.trade.completed",
        "marketplace.trade.cancelled",
    ),
    "issuance": (
        "carbon.issuance.approved",
        "carbon.credit.requested",
        "carbon.credit.issued",
        "carbon.credit.rejected",
    ),
    "payment": (
        "payment.payment.created",
        "payment.payment.success",
        "payment.payment.failed",
    ),
}
STREAMS = tuple(BINDINGS)

# Fixed value: the only row of a rejected message that is still stored is an issuance without status.
MISSING_STATUS = "missing status"

# Microseconds and offset are kept when an event is written back as JSON.
WIRE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

_NUMBER = '"{}"\\s*:\\s*"?([-+0-9.eE]+)'
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


# -- reading


def message_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """JSON lines with ``routing_key`` and ``value`` dropped into a folder."""
    return spark.readStream.schema("routing_key string, value string").options(**options).json(folder)


def kafka_messages(spark: SparkSession, stream: bool = True, **options: str) -> DataFrame:
    """Kafka records keyed by routing key (needs the Kafka connector on the class path)."""
    reader = spark.readStream if stream else spark.read
    return (
        reader.format("kafka")
        .options(**options)
        .load()
        .select(F.col("key").cast("string").alias("routing_key"), F.col("value").cast("string").alias("value"))
    )


# -- route, parse, check


def with_stream(messages: DataFrame) -> DataFrame:
    """Adds ``stream``, null where the routing key is unbound."""
    stream: Column = F.lit(None).cast("string")
    for name, keys in BINDINGS.items():
        stream = F.when(F.col("routing_key").isin(*keys), name).otherwise(stream)
    return messages.withColumn("stream", stream)


def route(messages: DataFrame) -> DataFrame:
    """Adds ``stream``; messages with an unbound routing key are dropped, as a topic exchange does."""
    return with_stream(messages).filter(F.col("stream").isNotNull())


def parsed(stream: str, value: str = "value") -> Column:
    """The JSON text as a typed struct; text that does not fit is put into the corrupt field whole."""
    return F.from_json(
        value,
        MESSAGES[stream],
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )


def decode(routed: DataFrame) -> DataFrame:
    """One struct column per stream (null for the others), plus ``event_id``, ``at`` and ``reason``.

    ``reason`` is null for usable messages.
    """
    of = {s: F.col("stream") == s for s in STREAMS}
    structs = (F.when(of[s], parsed(s)).alias(s) for s in STREAMS)

    def envelope(name: str) -> Column:
        return F.coalesce(*(F.col(f"{s}.{name}") for s in STREAMS))

    # Generating the structs, instead of projecting them, keeps the optimizer from copying the JSON
    # parsing into every later expression that reads one of their fields.
    typed = routed.select("*", F.inline(F.array(F.struct(*structs))))
    # The checks likewise: a filter on the reason would repeat them, and together with what follows they outgrow the size of method the JVM compiles.
    why = F.coalesce(*(F.when(of[s], reason(s)) for s in STREAMS))
    checked = F.struct(envelope("eventId").alias("event_id"), envelope("timestamp").alias("at"), why.alias("reason"))
    return typed.select("*", F.inline(F.array(checked)))


def reason(stream: str) -> Column:
    """Why a message cannot be stored, null if it can."""

    def f(name: str) -> Column:
        return F.col(f"{stream}.{name}")

    checks = [
        (F.col(stream).isNull() | f(CORRUPT).isNotNull(), "unparsable"),
        (f("eventId").isNull(), "missing event id"),
        (f("source").isNull(), "missing source"),
        *_CHECKS[stream](f),
    ]
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in checks))


def strict_id(column: Column) -> Column:
    """Digits with an optional sign; anything else, blanks included, is null."""
    return F.when(column.rlike("^[+-]?[0-9]+$"), column.try_cast("bigint"))


def _bad_uuid(column: Column) -> Column:
    return column.isNotNull() & ~column.rlike(_UUID)


def _user_checks(f) -> list[tuple[Column, str]]:
    known = f("action").isin("REGISTERED", "LOGGED_IN", "UPDATED", "DELETED", "ENABLED", "DISABLED")
    return [
        (f("action").isNull(), "missing action"),
        (known & f("userId").try_cast("bigint").isNull(), "bad user id"),
        (known & f("timestamp").isNull(), "missing timestamp"),
        ((f("action") == "REGISTERED") & f("role").isNull(), "missing role"),
    ]


def _trade_checks(f) -> list[tuple[Column, str]]:
    return [
        (f("orderId").isNull() | _bad_uuid(f("orderId")), "bad order id"),
        (_bad_uuid(f("listingId")), "bad listing id"),
        (_bad_uuid(f("auctionId")), "bad auction id"),
        (strict_id(f("buyerId")).isNull(), "bad buyer id"),
        (strict_id(f("sellerId")).isNull(), "bad seller id"),
        (f("quantity").isNull(), "missing quantity"),
        (f("unitPrice").isNull(), "missing unit price"),
        (f("amount").isNull(), "missing amount"),
        (f("timestamp").isNull(), "missing timestamp"),
    ]


def _issuance_checks(f) -> list[tuple[Column, str]]:
    return [
        (F.coalesce(f("issuanceId"), f("requestId")).isNull(), "missing issuance id"),
        (strict_id(f("userId")).isNull(), "bad user id"),
        (f("quantityTco2e").isNull(), "missing quantity"),
        (f("timestamp").isNull(), "missing timestamp"),
        (f("status").isNull(), MISSING_STATUS),
    ]


def _payment_checks(f) -> list[tuple[Column, str]]:
    when = F.coalesce(f("completedAt"), f("failedAt"), f("initiatedAt"))
    return [
        (f("paymentId").isNull(), "missing payment id"),
        (f("orderId").isNull(), "missing order id"),
        (f("amount").isNull(), "missing amount"),
        (f("status").isNull(), "missing status"),
        (when.isNull(), "missing payment time"),
    ]


_CHECKS = {
    "user": _user_checks,
    "trade": _trade_checks,
    "issuance": _issuance_checks,
    "payment": _payment_checks,
}


def usable(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNull())


def trimmed(decoded: DataFrame, *fields: str) -> DataFrame:
    """The same rows with these fields of each stream alone."""

    def some(stream: str) -> Column:
        return F.struct(*(F.col(f"{stream}.{f}") for f in fields if f in MESSAGES[stream].fieldNames()))

    return decoded.withColumns({s: F.when(F.col(s).isNotNull(), some(s)) for s in STREAMS})


def dead_letters(decoded: DataFrame, now: Column) -> DataFrame:
    return decoded.filter(F.col("reason").isNotNull()).select(
        "routing_key", "value", "stream", "reason", now.alias("rejected_at")
    )


# -- typed events in table terms


def payload(stream: str) -> Column:
    """The whole event as JSON text."""
    return F.to_json(F.col(stream).dropFields(CORRUPT), {"timestampFormat": WIRE_TIME})


def as_written(field: str) -> Column:
    """A number field of the message text, digit for digit (a parsed decimal has a fixed scale)."""
    return F.regexp_extract("value", _NUMBER.format(field), 1)


def part_written(field: str) -> Column:
    """What ``as_written`` needs of the message text."""
    return F.regexp_extract("value", _NUMBER.format(field), 0)


def user_events(decoded: DataFrame) -> DataFrame:
    return _of(decoded, "user").select(
        "event_id",
        F.col("user.userId").alias("user_text"),
        F.col("user.userId").try_cast("bigint").alias("user_id"),
        F.col("user.username"),
        F.col("user.email"),
        F.col("user.role"),
        F.col("user.region"),
        F.col("user.organizationName").alias("organization_name"),
        F.col("user.phoneNumber").alias("phone_number"),
        F.col("user.enabled"),
        F.col("user.action"),
        F.col("user.timestamp"),
        payload("user").alias("payload"),
    )


def trade_rows(decoded: DataFrame, now: Column) -> DataFrame:
    """Trade events as fact rows with arrival columns."""
    return _of(decoded, "trade").select(
        F.col("trade.orderId").alias("order_id"),
        strict_id(F.col("trade.buyerId")).alias("buyer_id"),
        strict_id(F.col("trade.sellerId")).alias("seller_id"),
        F.col("trade.listingId").alias("listing_id"),
        F.col("trade.quantity"),
        F.coalesce("trade.quantityUnit", F.lit("tCO2e")).alias("unit"),
        F.col("trade.unitPrice").alias("unit_price"),
        F.col("trade.amount"),
        F.col("trade.currency"),
        F.col("trade.timestamp").alias("executed_at"),
        F.col("trade.region"),
        F.col("trade.orderStatus").alias("order_status"),
        F.coalesce("trade.isAuction", F.lit(False)).alias("is_auction"),
        F.coalesce("trade.statusChangedAt", now).alias("status_changed_at"),
        F.col("at").alias("arrived_at"),
        "event_id",
    )


def payment_rows(decoded: DataFrame) -> DataFrame:
    when = F.coalesce("payment.completedAt", "payment.failedAt", "payment.initiatedAt")
    return _of(decoded, "payment").select(
        F.col("payment.paymentId").alias("payment_id"),
        F.col("payment.orderId").alias("order_id"),
        F.col("payment.amount"),
        F.col("payment.currency"),
        F.col("payment.status"),
        F.col("payment.paymentMethod").alias("payment_method"),
        when.alias("completed_at"),
        F.col("payment.payerId").alias("payer_id"),
        F.col("payment.payeeId").alias("payee_id"),
        F.col("payment.region"),
        F.col("payment.timestamp").alias("status_changed_at"),
        F.col("at").alias("arrived_at"),
        "event_id",
    )


def issuance_rows(decoded: DataFrame) -> DataFrame:
    return _of(decoded, "issuance").select(
        F.coalesce("issuance.issuanceId", "issuance.requestId").alias("issuance_id"),
        strict_id(F.col("issuance.userId")).alias("user_id"),
        F.col("issuance.requestId").alias("request_id"),
        F.col("issuance.quantityTco2e").alias("quantity_tco2e"),
        F.col("issuance.distanceKm").alias("distance_km"),
        F.col("issuance.energyKwh").alias("energy_kwh"),
        F.col("issuance.co2AvoidedKg").alias("co2_avoided_kg"),
        F.col("issuance.timestamp").alias("issued_at"),
        F.col("issuance.region"),
        F.col("issuance.vehicleId").alias("vehicle_id"),
        F.col("issuance.status"),
        F.col("at").alias("arrived_at"),
        "event_id",
    )


def _of(decoded: DataFrame, stream: str) -> DataFrame:
    return decoded.filter(F.col("stream") == stream)
