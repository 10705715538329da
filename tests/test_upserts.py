from datetime import datetime

from tests.helpers import dicts, frame, message, messages

from tradewind.functions.clock import moment
from tradewind.operators import upserts
from tradewind.sources import messages as msg

NOW = datetime(2024, 1, 30, 18)


def decode(spark, *rows):
    return msg.usable(msg.decode(msg.route(messages(spark, *rows))))


def trades(spark, *rows):
    return msg.trade_rows(decode(spark, *rows), moment(NOW))


def test_later_trade_row_replaces_all_columns(spark):
    rows = trades(
        spark,
        message("trade", "e1", region="North", quantityUnit="kg", isAuction=True),
        message("trade", "e2", amount=21),
    )
    (row,) = dicts(upserts.upsert(None, rows, "fact_trade"))
    assert (row["region"], row["unit"], row["is_auction"], int(row["amount"])) == (None, "tCO2e", False, 21)
    assert row["status_changed_at"] == NOW


def test_same_order_at_two_times_is_two_rows(spark):
    rows = trades(spark, message("trade", "e1"), message("trade", "e2", at="2024-01-11T00:00:00Z"))
    assert upserts.upsert(None, rows, "fact_trade").count() == 2


def test_stored_row_comes_first_whatever_the_ids(spark):
    stored = upserts.upsert(None, trades(spark, message("trade", "z9", amount=1)), "fact_trade")
    (row,) = dicts(upserts.upsert(stored, trades(spark, message("trade", "a0", amount=2)), "fact_trade"))
    assert int(row["amount"]) == 2


def test_null_currency_stays_null(spark):
    (row,) = dicts(upserts.upsert(None, trades(spark, message("trade", "e1", currency=None)), "fact_trade"))
    assert row["currency"] is None


def test_payment_keeps_first_amount_and_takes_last_status(spark):
    first = msg.payment_rows(decode(spark, message("payment", "e1", currency="VND")))
    second = msg.payment_rows(
        decode(
            spark,
            message("payment", "e2", amount=99, status="COMPLETED", currency="USD", orderId="o2", payerId=None),
        )
    )
    in_one = upserts.upsert(None, first.unionByName(second), "fact_payment")
    in_two = upserts.upsert(upserts.upsert(None, first, "fact_payment"), second, "fact_payment")
    for result in (in_one, in_two):
        (row,) = dicts(result)
        assert (int(row["amount"]), row["currency"], row["order_id"]) == (5, "VND", "o1")
        assert (row["status"], row["payer_id"]) == ("COMPLETED", None)


def test_issuance_keeps_request_id(spark):
    rows = msg.issuance_rows(
        decode(
            spark,
            message("issuance", "e1", issuanceId="i1", requestId="r1"),
            message("issuance", "e2", issuanceId="i1", requestId="r2", status="APPROVED"),
            message("issuance", "e3", issuanceId="i1", status="APPROVED", at="2024-01-12T00:00:00Z"),
        )
    )
    result = {str(r["issued_at"]): r for r in dicts(upserts.upsert(None, rows, "fact_issuance"))}
    assert len(result) == 2
    row = result["2024-01-10 10:00:00"]
    assert (row["request_id"], row["status"]) == ("r1", "APPROVED")


def test_replay_changes_nothing(spark):
    rows = trades(spark, message("trade", "e1"), message("trade", "e2", amount=21))
    once = upserts.upsert(None, rows, "fact_trade")
    twice = upserts.upsert(once, rows, "fact_trade")
    assert dicts(once) == dicts(twice)


# -- users


def fold(spark, stored, *rows):
    users = frame(spark, "dim_users", stored)
    result = upserts.fold_users(users, msg.user_events(decode(spark, *rows)))
    return {r["user_id"]: r for r in dicts(result)}


def user(event_id, hour, **fields):
    base = {"username": None, "role": None} if fields.get("action", "REGISTERED") != "REGISTERED" else {}
    return message("user", event_id, at=f"2024-01-10T{hour:02d}:00:00Z", **{**base, **fields})


def test_registration_sets_everything_and_keeps_created_at(spark):
    users = fold(
        spark,
        [],
        user("e1", 1, email="a@x", phoneNumber="1"),
        user("e2", 2, username=None, enabled=False),
    )
    row = users[7]
    assert (row["username"], row["email"], row["phone_number"], row["enabled"]) == (None, None, None, False)
    assert (row["created_at"].hour, row["updated_at"].hour, row["last_login_at"].hour) == (1, 2, 2)


def test_update_fills_only_what_it_has(spark):
    users = fold(spark, [], user("e1", 1, email="a@x"), user("e2", 2, action="UPDATED", username="bob"))
    row = users[7]
    assert (row["username"], row["email"], row["role"]) == ("bob", "a@x", "BUYER")
    assert (row["updated_at"].hour, row["last_login_at"].hour) == (2, 1)


def test_unknown_user_is_not_created(spark):
    assert fold(spark, [], user("e1", 1, action="LOGGED_IN")) == {}


def test_events_before_registration_do_not_count(spark):
    row = fold(spark, [], user("e0", 0, action="LOGGED_IN"), user("e1", 1))[7]
    assert (row["created_at"].hour, row["last_login_at"].hour) == (1, 1)


def test_delete_and_status(spark):
    assert fold(spark, [], user("e1", 1), user("e2", 2, action="DELETED"))[7]["enabled"] is False
    assert fold(spark, [], user("e1", 1), user("e2", 2, action="DISABLED"))[7]["enabled"] is None
    assert fold(spark, [], user("e1", 1), user("e2", 2, action="DISABLED", enabled=True))[7]["enabled"] is True
    assert fold(spark, [], user("e1", 1), user("e2", 2, action="DANCED"))[7]["updated_at"].hour == 1


def test_equal_times_go_by_event_id(spark):
    row = fold(spark, [], user("e1", 1), user("e3", 2, action="UPDATED", username="c"), user("e2", 2, action="UPDATED", username="b"))[7]
    assert row["username"] == "c"


def test_late_older_event_overrides_the_snapshot(spark):
    stored = [{"user_id": 7, "username": "new", "role": "R", "created_at": "2024-01-20 00:00:00", "updated_at": "2024-01-25 00:00:00"}]
    row = fold(spark, stored, user("e1", 1, action="UPDATED", username="old"))[7]
    assert (row["username"], row["updated_at"].day, row["created_at"].day) == ("old", 10, 20)


def test_snapshot_without_events_is_unchanged(spark):
    stored = [{"user_id": 1, "username": "x", "role": "R", "enabled": False, "region": None, "last_login_at": "2024-01-02 00:00:00"}]
    before = dicts(frame(spark, "dim_users", stored))
    events = msg.user_events(decode(spark, user("e1", 1)))
    after = dicts(upserts.fold_users(frame(spark, "dim_users", stored), events).filter("user_id = 1"))
    assert after == before


def test_unknown_action_makes_no_activity(spark):
    events = msg.user_events(decode(spark, user("e1", 1), user("e2", 2, action="DANCED")))
    assert dicts(upserts.activities(events), "event_type") == [{"event_type": "REGISTERED"}]


def test_folds_combine_on_the_map_side(spark):
    rows = trades(spark, message("trade", "e1")).repartition(3)
    plan = upserts.upsert(None, rows, "fact_trade")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
