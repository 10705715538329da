"""Table and message schemas, and the step that brings any frame into them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,6)"
MEASURE = "decimal(12,2)"


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _type(name: str) -> T.DataType:
    if name.startswith("decimal("):
        precision, scale = name[len("decimal(") : -1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return _TYPES[name]


def _struct(fields: str) -> T.StructType:
    """``name type, name type`` as a struct; unlike ``fromDDL`` it needs no running session."""
    pairs = (f.split() for f in fields.split(", "))
    return T.StructType([T.StructField(name, _type(kind)) for name, kind in pairs])


@dataclass(frozen=True)
class Table:
    """A stored table: columns, business key, and the column that dates a row."""

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    time: str | None = None
    defaults: dict[str, object] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)
    lookups: tuple[str, ...] = ()  # columns that single values are looked up in: rows lie sorted by the first, and all have bloom filters

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


_TABLES = [
    Table(
        "fact_trade",
        _struct(
            f"order_id string, buyer_id bigint, seller_id bigint, listing_id string, quantity {MONEY}, "
            f"unit string, unit_price {MONEY}, amount {MONEY}, currency string, executed_at timestamp, "
            "region string, order_status string, is_auction boolean, status_changed_at timestamp"
        ),
        key=("order_id", "executed_at"),
        time="executed_at",
        defaults={"unit": "tCO2e", "currency": "VND", "is_auction": False},
    ),
    Table(
        "fact_payment",
        _struct(
            f"payment_id string, order_id string, amount {MONEY}, currency string, status string, "
            "payment_method string, completed_at timestamp, payer_id string, payee_id string, "
            "region string, status_changed_at timestamp"
        ),
        key=("payment_id", "completed_at"),
        time="completed_at",
        defaults={"currency": "VND"},
    ),
    Table(
        "fact_issuance",
        _struct(
            f"issuance_id string, user_id bigint, request_id string, quantity_tco2e {MONEY}, "
            f"distance_km {MEASURE}, energy_kwh {MEASURE}, co2_avoided_kg {MEASURE}, issued_at timestamp, "
            "region string, vehicle_id string, status string"
        ),
        key=("issuance_id", "issued_at"),
        time="issued_at",
        defaults={"status": "APPROVED"},
    ),
    Table(
        "fact_user_activity",
        _struct("user_id bigint, event_type string, event_data string, occurred_at timestamp"),
        time="occurred_at",
    ),
    Table(
        "dim_users",
        _struct(
            "user_id bigint, username string, email string, role string, organization_name string, "
            "region string, created_at timestamp, enabled boolean, updated_at timestamp, "
            "last_login_at timestamp, phone_number string"
        ),
        key=("user_id",),
        time="created_at",
        defaults={"enabled": True},
        renames={"org": "organization_name"},
    ),
    Table(
        "dim_project",
        _struct("project_id string, seller_id bigint, type string, region string, created_at timestamp"),
        key=("project_id",),
    ),
    Table(
        "consumed_events",
        _struct("event_id string, received_at timestamp, event_type string, payload string"),
        key=("event_id",),
        time="received_at",
    ),
    Table(
        "system_logs",
        _struct(
            "id string, log_level string, source_service string, category string, message string, "
            "details string, correlation_id string, user_id string, ip_address string, log_timestamp timestamp"
        ),
        key=("id",),
        time="log_timestamp",
        lookups=("correlation_id", "user_id"),
    ),
    Table(
        "system_notifications",
        _struct(
            "notification_id string, level string, category string, title string, message string, "
            "source_service string, target_service string, target_user_id string, read_status boolean, "
            "read_at timestamp, created_at timestamp, expires_at timestamp"
        ),
        key=("notification_id",),
        time="created_at",
        defaults={"read_status": False},
    ),
    Table(
        "mv_refresh_log",
        _struct(
            "mv_name string, refresh_started_at timestamp, refresh_completed_at timestamp, status string, "
            "error_message string, rows_affected bigint"
        ),
        key=("mv_name", "refresh_started_at"),
        time="refresh_started_at",
    ),
    Table(
        "dead_letters",
        _struct("routing_key string, value string, stream string, reason string, rejected_at timestamp"),
        time="rejected_at",
    ),
    Table(
        "event_counters",
        _struct(
            "user_registered bigint, user_login bigint, trade_executed bigint, credit_issued bigint, "
            "payment_completed bigint, payment_failed bigint, processing_errors bigint, counted_at timestamp"
        ),
        time="counted_at",
    ),
    Table(
        "mv_trades_daily",
        _struct(
            "day timestamp, credits_sold decimal(28,6), revenue decimal(28,6), trade_count bigint, "
            "avg_unit_price decimal(22,10), unique_buyers bigint, unique_sellers bigint"
        ),
        key=("day",),
        time="day",
    ),
    Table(
        "mv_issuance_daily",
        _struct(
            "day timestamp, credits_issued decimal(28,6), issuance_count bigint, "
            "avg_issuance decimal(22,10), unique_users bigint"
        ),
        key=("day",),
        time="day",
    ),
    Table(
        "mv_payments_daily",
        _struct(
            "day timestamp, total_payments decimal(28,6), payment_count bigint, "
            "avg_payment decimal(22,10), payment_methods_used bigint"
        ),
        key=("day",),
        time="day",
    ),
    Table(
        "mv_user_activity_daily",
        _struct("day timestamp, event_type string, event_count bigint, unique_users bigint"),
        key=("day", "event_type"),
        time="day",
    ),
    Table(
        "dim_user_changes",
        T.StructType(
            [
                T.StructField("user_id", T.LongType()),
                *(
                    T.StructField(c, _struct(f"at timestamp, by string, value {kind}"))
                    for c, kind in {
                        **dict.fromkeys(("username", "email", "role", "organization_name", "region", "phone_number"), "string"),
                        "enabled": "boolean",
                        **dict.fromkeys(("created_at", "updated_at", "last_login_at"), "timestamp"),
                    }.items()
                ),
            ]
        ),
        key=("user_id",),
    ),
    Table(
        "notification_reads",
        _struct("notification_id string, read_at timestamp"),
        key=("notification_id",),
    ),
    *(
        Table(
            f"{name}_state",
            _struct("day timestamp, event_type string, measure string, value string, n bigint, total decimal(28,6)"),
            key=("day", "event_type", "measure", "value"),
            time="day",
        )
        for name in ("mv_trades_daily", "mv_issuance_daily", "mv_payments_daily", "mv_user_activity_daily")
    ),
]
TABLES: dict[str, Table] = {t.name: t for t in _TABLES}

# How long each fact is kept, in months.
RETENTION_MONTHS = {
    "fact_trade": 24,
    "fact_payment": 24,
    "fact_issuance": 24,
    "fact_user_activity": 12,
}

# ---- messages ---------------------------------------------------------------

CORRUPT = "_unparsable"
_ENVELOPE = (
    "eventId string, eventType string, source string, timestamp timestamp, version string, "
    "correlationId string, userId string"
)


def _message(fields: str) -> T.StructType:
    return _struct(f"{_ENVELOPE}, {fields}, {CORRUPT} string")


MESSAGES: dict[str, T.StructType] = {
    "user": _message(
        "username string, email string, role string, region string, enabled boolean, action string, "
        "ipAddress string, userAgent string, organizationName string, vehicleMake string, "
        "vehicleModel string, phoneNumber string"
    ),
    "trade": _message(
        f"orderId string, listingId string, buyerId string, sellerId string, quantity {MONEY}, "
        f"quantityUnit string, unitPrice {MONEY}, amount {MONEY}, currency string, orderStatus string, "
        "region string, statusChangedAt timestamp, isAuction boolean, auctionId string"
    ),
    "issuance": _message(
        f"issuanceId string, requestId string, vehicleId string, quantityTco2e {MONEY}, "
        f"distanceKm {MEASURE}, energyKwh {MEASURE}, co2AvoidedKg {MEASURE}, status string, region string, "
        "vehicleMake string, vehicleModel string, vehicleType string"
    ),
    "payment": _message(
        f"paymentId string, orderId string, payerId string, payeeId string, amount {MONEY}, currency string, "
        "status string, paymentMethod string, region string, initiatedAt timestamp, completedAt timestamp, "
        "failedAt timestamp, errorCode string, errorMessage string"
    ),
    "notification": _message(
        "notificationId string, level string, category string, title string, message string, "
        "targetService string, targetUserId string, read boolean"
    ),
}


# ---- conform ----------------------------------------------------------------


def conform(df: DataFrame, table: Table | str) -> DataFrame:
    """Old or partial layouts -> the current one: rename, add with default, cast, order."""
    table = TABLES[table] if isinstance(table, str) else table
    have = set(df.columns)
    old_name = {new: old for old, new in table.renames.items()}

    def column(f: T.StructField) -> Column:
        if f.name in have:
            value = F.col(f.name)
        elif old_name.get(f.name) in have:
            value = F.col(old_name[f.name])
        else:
            value = F.lit(table.defaults.get(f.name))
        return value.cast(f.dataType).alias(f.name)

    return df.select(*(column(f) for f in table.schema.fields))
