import pytest
from tests.helpers import UUID, dicts, message, messages
from pyspark.sql import functions as F

from tradewind.sources import messages as msg


def decode(spark, *rows):
    return msg.decode(msg.route(messages(spark, *rows)))


def reasons(spark, *rows):
    return {r["event_id"]: r["reason"] for r in dicts(decode(spark, *rows), "event_id", "reason")}


def test_all_fifteen_keys_are_bound():
    assert {s: len(k) for s, k in msg.BINDINGS.items()} == {"user": 4, "trade": 4, "issuance": 4, "payment": 3}


def test_unknown_routing_key_is_dropped(spark):
    routed = msg.route(messages(spark, ("auth.user.banned", "{}"), ("auth.user.registered", "{}")))
    assert dicts(routed, "stream") == [{"stream": "user"}]


def test_unparsable_json_is_refused(spark):
    rows = decode(spark, ("auth.user.updated", '{"eventId": "e1"'), ("auth.user.updated", "nonsense"))
    assert [r["reason"] for r in dicts(rows, "reason")] == ["unparsable"] * 2


def test_wrong_type_is_refused(spark):
    rows = decode(spark, message("trade", "e1", amount="much"))
    assert dicts(rows, "reason") == [{"reason": "unparsable"}]


def test_unknown_json_fields_are_ignored(spark):
    assert reasons(spark, message("user", "e1", shoeSize=44)) == {"e1": None}


@pytest.mark.parametrize(
    ("buyer", "reason"),
    [("12", None), ("-3", None), ("", "bad buyer id"), (None, "bad buyer id"), ("x1", "bad buyer id"), (" 12", "bad buyer id"), ("99999999999999999999", "bad buyer id")],
)
def test_buyer_ids(spark, buyer, reason):
    assert reasons(spark, message("trade", "e1", buyerId=buyer)) == {"e1": reason}


def test_trade_needs_a_uuid(spark):
    assert reasons(
        spark,
        message("trade", "e1", orderId="42"),
        message("trade", "e2", listingId="42"),
        message("trade", "e3", listingId=UUID(5)),
    ) == {"e1": "bad order id", "e2": "bad listing id", "e3": None}


def test_user_checks(spark):
    assert reasons(
        spark,
        message("user", "e1", userId="abc"),
        message("user", "e2", userId=None, action="DANCED"),
        message("user", "e3", action=None),
        message("user", "e4", role=None),
        message("user", "e5", role=None, action="UPDATED"),
        message("user", "e6", source=None),
    ) == {
        "e1": "bad user id",
        "e2": None,
        "e3": "missing action",
        "e4": "missing role",
        "e5": None,
        "e6": "missing source",
    }


def test_payment_time(spark):
    rows = decode(
        spark,
        message("payment", "e1"),
        message("payment", "e2", initiatedAt=None),
        message("payment", "e3", failedAt="2024-01-11T00:00:00Z"),
        message("payment", "e4", failedAt="2024-01-11T00:00:00Z", completedAt="2024-01-12T00:00:00+07:00"),
    )
    assert {r["event_id"]: r["reason"] for r in dicts(rows)}["e2"] == "missing payment time"
    times = msg.payment_rows(msg.usable(rows)).select("event_id", F.col("completed_at").cast("string").alias("t"))
    assert {r["event_id"]: r["t"] for r in dicts(times)} == {
        "e1": "2024-01-10 10:00:00",
        "e3": "2024-01-11 00:00:00",
        "e4": "2024-01-11 17:00:00",
    }


def test_issuance_takes_request_id_when_it_has_no_own(spark):
    rows = decode(spark, message("issuance", "e1"), message("issuance", "e2", issuanceId="i2"))
    ids = {r["event_id"]: r["issuance_id"] for r in dicts(msg.issuance_rows(rows))}
    assert ids == {"e1": "r1", "e2": "i2"}


def test_payload_keeps_microseconds(spark):
    rows = decode(spark, message("user", "e1", at="2024-01-10T10:00:00.123456Z"))
    sent = rows.select(F.get_json_object(msg.payload("user"), "$.timestamp").alias("t"))
    assert dicts(sent) == [{"t": "2024-01-10T10:00:00.123456Z"}]


def test_json_is_parsed_once_per_message(spark):
    """Reading many fields must not copy the parsing into every expression."""
    rows = decode(spark, message("user", "e1")).filter("reason IS NULL")
    plan = msg.user_events(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= len(msg.STREAMS)
