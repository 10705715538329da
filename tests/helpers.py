"""Literal tables and messages."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tradewind.schemas import TABLES
from tradewind.sources.tables import Tables

AS_OF = datetime(2024, 1, 30, 18, 0, 0)


class MemoryTables(Tables):
    """Tables made of a few literal rows; missing columns get their defaults."""

    def __init__(self, spark, **rows):
        super().__init__(spark)
        self.rows = rows

    def load(self, name, floor=None):
        return frame(self.spark, name, self.rows.get(name, []))


def frame(spark, table, rows):
    spec = TABLES[table]
    full = [{**spec.defaults, **r} for r in rows]
    values = [tuple(r.get(c) for c in spec.columns) for r in full]
    text = [tuple(None if v is None else v if isinstance(v, bool) else str(v) for v in row) for row in values]
    schema = ", ".join(f"{c} {'boolean' if spec.schema[c].dataType.simpleString() == 'boolean' else 'string'}" for c in spec.columns)
    df = spark.createDataFrame(text, schema)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields))


ENVELOPE = {"eventType": "X", "source": "svc", "version": "1", "correlationId": "c-1"}
UUID = "00000000-0000-0000-0000-{:012d}".format

_ROUTES = {
    "user": "auth.user.updated",
    "trade": "marketplace.trade.created",
    "issuance": "carbon.credit.requested",
    "payment": "payment.payment.created",
}
_BASE = {
    "user": {"userId": "7", "action": "REGISTERED", "username": "ann", "role": "BUYER"},
    "trade": {
        "orderId": UUID(1),
        "buyerId": "12",
        "sellerId": "13",
        "quantity": 2,
        "unitPrice": 10,
        "amount": 20,
        "currency": "VND",
        "orderStatus": "CREATED",
    },
    "issuance": {"userId": "7", "requestId": "r1", "quantityTco2e": 1.005, "status": "PENDING"},
    "payment": {"paymentId": "p1", "orderId": "o1", "amount": 5, "status": "PENDING", "payerId": "9"},
}


def message(stream, event_id, at="2024-01-10T10:00:00Z", **fields):
    body = {**ENVELOPE, "eventId": event_id, "timestamp": at, **_BASE[stream]}
    if stream == "payment":
        body["initiatedAt"] = at
    body.update(fields)
    return (_ROUTES[stream], json.dumps({k: v for k, v in body.items() if v is not None}))


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), "routing_key string, value string")


def dicts(df, *columns):
    df = df.select(*columns) if columns else df
    return [r.asDict() for r in df.collect()]
