"""For each query, SQL over the same tables (DuckDB dialect) that must give the same rows."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-30 18:00:00'"
TODAY = "TIMESTAMP '2024-01-30 00:00:00'"


def num(expression: str) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE), 6)"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def ago(n: int, unit: str = "DAY") -> str:
    return f"{AS_OF} - INTERVAL {n} {unit}"


# ---- the given tables as the star schema ------------------------------------

_PLACES = """
  SELECT c_custkey, c_name, c_mktsegment, CASE WHEN n_nationkey % 7 <> 0 THEN r_name END AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

TABLES = {
    "places": _PLACES,
    "fact_trade": """
  SELECT concat(l_orderkey, '-', l_linenumber) AS order_id, o_custkey AS buyer_id, l_suppkey AS seller_id,
    CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS listing_id,
    CAST(l_quantity AS DECIMAL(18,6)) AS quantity, CAST(p_retailprice AS DECIMAL(18,6)) AS unit_price,
    CAST(l_extendedprice AS DECIMAL(18,6)) AS amount, 'VND' AS currency,
    l_shipdate + INTERVAL 8122 DAY AS executed_at, region,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_auction,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'CREATED' ELSE 'PENDING_PAYMENT' END AS order_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN places ON o_custkey = c_custkey""",
    "fact_payment": """
  SELECT CAST(o_orderkey AS VARCHAR) AS payment_id, CAST(o_totalprice AS DECIMAL(18,6)) AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
    o_orderpriority AS payment_method, o_orderdate + INTERVAL 8217 DAY AS completed_at FROM orders""",
    "fact_issuance": """
  SELECT CAST(event_id AS VARCHAR) AS issuance_id, user_id, CAST(value AS DECIMAL(18,6)) AS quantity_tco2e,
    CAST(json_extract_string(props, '$.k') AS DECIMAL(12,2)) AS distance_km,
    CASE WHEN event_id % 5 <> 0 THEN CAST(value AS DECIMAL(12,2)) END AS energy_kwh,
    CAST(user_id AS DECIMAL(12,2)) AS co2_avoided_kg, ts AS issued_at, region
  FROM events JOIN places ON user_id = c_custkey WHERE event_type IN ('purchase', 'view', 'error')""",
    "fact_user_activity": """
  SELECT CASE WHEN user_id % 20 = 19 THEN -user_id ELSE user_id END AS user_id, event_type, props AS event_data,
    ts AS occurred_at FROM events""",
    "dim_users": """
  SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS role, region,
    first_order + INTERVAL 8217 DAY AS created_at, c_custkey % 11 <> 0 AS enabled
  FROM places LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order FROM orders GROUP BY 1) f
    ON o_custkey = c_custkey""",
    "consumed_events": """
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS received_at, CASE event_type WHEN 'signup' THEN 'USER_EVENT'
    WHEN 'purchase' THEN 'TRADE_EVENT' WHEN 'view' THEN 'ISSUANCE_EVENT' WHEN 'click' THEN 'PAYMENT_EVENT' END
    AS event_type FROM events""",
    "event_deliveries": """
  SELECT * FROM consumed_events UNION ALL
  SELECT * FROM consumed_events WHERE CAST(event_id AS BIGINT) % 50 = 0""",
    "system_logs": """
  SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG'
    WHEN 'click' THEN 'WARN' ELSE 'INFO' END AS log_level, concat('svc-', user_id % 5) AS source_service,
    CASE WHEN event_id % 2 = 0 THEN 'BUSINESS' ELSE 'SYSTEM' END AS category, props AS details,
    concat('c-', event_id % 97) AS correlation_id, CAST(user_id AS VARCHAR) AS user_id, ts AS log_timestamp
  FROM events""",
    "system_notifications": """
  SELECT concat('n-', event_id) AS notification_id, CASE event_type WHEN 'error' THEN 'WARNING' ELSE 'INFO' END
    AS level, CASE WHEN event_id % 2 = 0 THEN 'BUSINESS' ELSE 'SYSTEM' END AS category, event_type AS title,
    CASE WHEN event_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS target_user_id,
    event_id % 3 = 0 AS read_status, ts AS created_at,
    CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 72 HOUR END AS expires_at
  FROM events WHERE event_type IN ('error', 'signup')""",
    "mv_refresh_log": """
  SELECT CASE event_id % 4 WHEN 0 THEN 'mv_trades_daily' WHEN 1 THEN 'mv_issuance_daily'
    WHEN 2 THEN 'mv_payments_daily' ELSE 'mv_user_activity_daily' END AS mv_name, ts AS refresh_started_at,
    CASE WHEN event_type <> 'view' THEN ts + to_seconds(event_id % 900) END AS refresh_completed_at,
    CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    CASE WHEN event_type = 'error' THEN concat('failed on ', props) END AS error_message,
    CASE WHEN event_type NOT IN ('view', 'error') THEN event_id % 1000 END AS rows_affected,
    CASE WHEN event_type <> 'view' THEN CAST(event_id % 900 * 1000 AS DOUBLE) END AS duration_ms
  FROM events""",
    "mv_trades_daily": f"""
  SELECT date_trunc('day', executed_at) AS day, {num("SUM(quantity)")} AS credits_sold,
    {num("SUM(amount)")} AS revenue, COUNT(*) AS trade_count,
    ROUND(CAST(SUM(unit_price) AS DOUBLE) / COUNT(*), 6) AS avg_unit_price,
    COUNT(DISTINCT buyer_id) AS unique_buyers, COUNT(DISTINCT seller_id) AS unique_sellers
  FROM fact_trade GROUP BY 1""",
    "mv_issuance_daily": f"""
  SELECT date_trunc('day', issued_at) AS day, {num("SUM(quantity_tco2e)")} AS credits_issued,
    COUNT(*) AS issuance_count, ROUND(CAST(SUM(quantity_tco2e) AS DOUBLE) / COUNT(*), 6) AS avg_issuance,
    COUNT(DISTINCT user_id) AS unique_users FROM fact_issuance GROUP BY 1""",
    "mv_payments_daily": f"""
  SELECT date_trunc('day', completed_at) AS day, {num("SUM(amount)")} AS total_payments,
    COUNT(*) AS payment_count, ROUND(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 6) AS avg_payment,
    COUNT(DISTINCT payment_method) AS payment_methods_used
  FROM fact_payment WHERE status = 'COMPLETED' GROUP BY 1""",
    "mv_user_activity_daily": """
  SELECT date_trunc('day', occurred_at) AS day, event_type, COUNT(*) AS event_count,
    COUNT(DISTINCT user_id) AS unique_users FROM fact_user_activity GROUP BY 1, 2""",
    "co2_stats": f"""
  SELECT COALESCE(region, 'Unknown') AS region, date_trunc('day', issued_at) AS date, COUNT(*) AS issuance_count,
    {num("SUM(quantity_tco2e)")} AS total_tco2e, {num("SUM(distance_km)")} AS total_distance_km,
    {num("SUM(energy_kwh)")} AS total_energy_kwh, {num("SUM(co2_avoided_kg)")} AS total_co2_avoided_kg
  FROM fact_issuance WHERE issued_at >= {TODAY} - INTERVAL 90 DAY GROUP BY 1, 2""",
    "trade_stats": f"""
  SELECT COALESCE(region, 'Unknown') AS region, currency, date_trunc('day', executed_at) AS date,
    COUNT(*) AS trade_count, {num("SUM(quantity)")} AS total_quantity, {num("SUM(amount)")} AS total_amount
  FROM fact_trade WHERE executed_at >= {TODAY} - INTERVAL 90 DAY GROUP BY 1, 2, 3""",
    "user_stats": """
  SELECT COALESCE(region, 'Unknown') AS region, role, COUNT(*) AS user_count FROM dim_users GROUP BY 1, 2""",
}

# ---- the given tables as messages -------------------------------------------


def _twice(select: str, again: str) -> str:
    return f"SELECT * FROM ({select}) UNION ALL SELECT * FROM ({select}) WHERE {again}"


_TRADE_MESSAGES = """
  SELECT concat('t-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', strftime(l_shipdate, '%Y%m%d'))
      AS event_id,
    CASE o_orderstatus WHEN 'F' THEN 'marketplace.trade.completed' WHEN 'O' THEN 'marketplace.trade.created'
      ELSE 'marketplace.trade.updated' END AS routing_key,
    l_shipdate + INTERVAL 8122 DAY AS sent, concat('c-', l_orderkey) AS correlation, CAST(o_custkey AS VARCHAR) AS who,
    printf('00000000-0000-0000-%04d-%012d', l_linenumber, l_orderkey) AS order_id,
    CASE WHEN l_partkey % 10 <> 0 THEN printf('00000000-0000-0000-%04d-%012d', l_linenumber, l_partkey) END AS listing,
    CASE l_partkey % 40 WHEN 0 THEN concat('x', o_custkey) WHEN 1 THEN '' WHEN 2 THEN NULL
      ELSE CAST(o_custkey AS VARCHAR) END AS buyer_text,
    CAST(l_suppkey AS VARCHAR) AS seller_text, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
    CASE WHEN l_suppkey % 2 = 0 THEN 'kgCO2e' END AS unit, CAST(l_tax AS DECIMAL(18,2)) AS unit_price,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_suppkey % 9 <> 0 THEN 'VND' END AS currency,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'PENDING_PAYMENT' ELSE 'CREATED' END AS status,
    CASE WHEN l_suppkey % 3 <> 0 THEN o_orderdate + INTERVAL 8217 DAY END AS status_at,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_auction,
    CASE WHEN l_partkey % 40 < 3 THEN 'bad buyer id' END AS reason, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

_PAYMENT_MESSAGES = """
  SELECT concat('p-', o_orderkey) AS event_id,
    CASE o_orderstatus WHEN 'F' THEN 'payment.payment.success' WHEN 'O' THEN 'payment.payment.created'
      ELSE 'payment.payment.failed' END AS routing_key,
    o_orderdate + INTERVAL 8217 DAY AS sent, concat('c-', o_orderkey) AS correlation,
    CAST(o_custkey AS VARCHAR) AS who, concat('pay-', o_orderkey) AS payment_id,
    CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'PENDING'
      WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'FAILED' END AS status,
    o_orderpriority AS method, o_orderstatus AS s, o_orderkey AS k,
    CASE WHEN o_orderkey % 2 = 0 THEN 'card declined' END AS error,
    CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'missing payment time' END AS reason
  FROM orders"""

_USER_MESSAGES = """
  SELECT *, CASE WHEN action IS NULL THEN 'missing action'
    WHEN action <> 'ARCHIVED' AND k % 31 = 0 THEN 'bad user id' END AS reason FROM (
  SELECT concat('u-', event_id) AS event_id,
    CASE event_type WHEN 'signup' THEN 'auth.user.registered' WHEN 'click' THEN 'auth.user.loggedin'
      WHEN 'error' THEN 'auth.user.deleted' ELSE 'auth.user.updated' END AS routing_key,
    ts AS sent, concat('c-', event_id % 97) AS correlation,
    CASE WHEN event_id % 31 = 0 THEN concat('u', user_id) ELSE CAST(user_id AS VARCHAR) END AS who,
    CASE WHEN told THEN concat('user-', event_id) END AS username,
    CASE WHEN told AND event_id % 4 <> 0 THEN concat(event_id, '@example.org') END AS email,
    CASE WHEN event_type = 'signup' OR (event_type = 'view' AND event_id % 3 = 0)
      THEN concat('role-', event_id % 4) END AS role,
    CASE WHEN told AND event_id % 7 <> 0 THEN concat('region-', event_id % 5) END AS region,
    CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS enabled,
    CASE WHEN event_type = 'signup' THEN 'REGISTERED' WHEN event_type = 'click' THEN 'LOGGED_IN'
      WHEN event_type = 'view' THEN 'UPDATED' WHEN event_type = 'error' THEN 'DELETED'
      WHEN event_id % 3 = 0 THEN 'ENABLED' WHEN event_id % 3 = 1 THEN 'DISABLED'
      WHEN event_id % 5 <> 0 THEN 'ARCHIVED' END AS action,
    CASE WHEN event_id % 6 = 0 THEN CAST(event_id AS VARCHAR) END AS phone, event_id AS k, user_id
  FROM (SELECT *, event_type = 'signup' OR (event_type = 'view' AND event_id % 2 = 1) AS told FROM events))"""

_ISSUANCE_MESSAGES = """
  SELECT concat('i-', event_id) AS event_id,
    CASE event_type WHEN 'purchase' THEN 'carbon.credit.issued' WHEN 'view' THEN 'carbon.credit.requested'
      ELSE 'carbon.credit.rejected' END AS routing_key,
    ts AS sent, concat('c-', event_id % 97) AS correlation, CAST(user_id AS VARCHAR) AS who,
    CASE WHEN event_type = 'purchase' THEN concat('iss-', event_id) END AS issuance_id,
    concat('req-', event_id) AS request_id, concat('v-', event_id % 13) AS vehicle,
    CAST(value AS DECIMAL(18,2)) AS quantity, CAST(json_extract_string(props, '$.k') AS DECIMAL(12,2)) AS distance,
    CASE WHEN event_id % 5 <> 0 THEN CAST(value AS DECIMAL(12,2)) END AS energy,
    CAST(user_id AS DECIMAL(12,2)) AS avoided,
    CASE WHEN event_id % 100 = 99 THEN NULL WHEN event_type = 'purchase' THEN 'APPROVED'
      WHEN event_type = 'view' THEN 'PENDING' ELSE 'REJECTED' END AS status,
    CASE WHEN event_id % 100 = 99 THEN 'missing status' END AS reason, event_id AS k
  FROM events WHERE event_type IN ('purchase', 'view', 'error')"""

TABLES |= {
    "trade_once": _TRADE_MESSAGES,
    "payment_once": _PAYMENT_MESSAGES,
    "user_once": _USER_MESSAGES,
    "issuance_once": _ISSUANCE_MESSAGES,
    "trade_messages": _twice("SELECT * FROM trade_once", "part % 50 = 0"),
    "payment_messages": _twice("SELECT * FROM payment_once", "k % 50 = 0"),
    "user_messages": _twice("SELECT * FROM user_once", "k % 50 = 0"),
    "issuance_messages": _twice("SELECT * FROM issuance_once", "k % 50 = 0"),
    "dead": """
  SELECT routing_key, 'trade' AS stream, reason, event_id FROM trade_messages WHERE reason IS NOT NULL
  UNION ALL SELECT routing_key, 'payment', reason, event_id FROM payment_messages WHERE reason IS NOT NULL
  UNION ALL SELECT routing_key, 'user', reason, event_id FROM user_messages WHERE reason IS NOT NULL
  UNION ALL SELECT routing_key, 'issuance', reason, event_id FROM issuance_messages WHERE reason IS NOT NULL
  UNION ALL SELECT 'auth.user.updated', 'user', 'unparsable', NULL FROM supplier""",
    "good": """
  SELECT event_id, 'trade' AS stream, 'marketplace-service' AS source, correlation, buyer_text AS who,
    status AS shown FROM trade_once WHERE reason IS NULL
  UNION ALL SELECT event_id, 'payment', 'payment-service', correlation, who, status FROM payment_once
    WHERE reason IS NULL
  UNION ALL SELECT event_id, 'user', 'auth-service', correlation, who, action FROM user_once WHERE reason IS NULL
  UNION ALL SELECT event_id, 'issuance', 'carbon-service', correlation, who, status FROM issuance_once
    WHERE reason IS NULL""",
}


def _notice(rule: str, level: str, title: str, message: str, target: str, hours: int, source: str, table: str) -> str:
    return f"""
  SELECT sha256(concat(event_id, '|{rule}')) AS notification_id, '{level}' AS level, 'BUSINESS' AS category,
    '{title}' AS title, {message} AS message, '{source}' AS source_service, {target} AS target_user_id,
    false AS read_status, {AS_OF} AS created_at, {AS_OF} + INTERVAL {hours} HOUR AS expires_at
  FROM {table}"""


_NOTHING = "CAST(NULL AS VARCHAR)"
_TONNES = "CAST(quantity AS VARCHAR)"


def _issuance_notice(status: str, level: str, title: str, message: str) -> str:
    table = f"issuance_once WHERE reason IS NULL AND status = '{status}'"
    rule = f"issuance_{status.lower()}"
    return _notice(rule, level, title, message, "who", 168, "carbon-service", table)


TABLES |= {
    "notice_user": _notice(
        "user_registered", "INFO", "New User Registered", "concat('User ', username, ' registered with role ', role)",
        _NOTHING, 72, "auth-service", "user_once WHERE reason IS NULL AND action = 'REGISTERED'",
    ),
    "notice_trade": _notice(
        "high_value_trade", "INFO", "High-Value Trade Executed",
        "concat('Trade of ', CAST(amount AS VARCHAR), ' ', COALESCE(currency, 'null'), ' executed')",
        _NOTHING, 24, "marketplace-service", "trade_once WHERE reason IS NULL AND amount > 50000",
    ),
    "notice_issuance": " UNION ALL ".join(
        [
            _issuance_notice("PENDING", "INFO", "Carbon Credit Request Submitted",
                f"concat('Your carbon credit request for ', {_TONNES}, ' tCO2e is being reviewed')"),
            _issuance_notice("APPROVED", "SUCCESS", "Carbon Credits Issued",
                f"concat({_TONNES}, ' tCO2e carbon credits have been issued to your account')"),
            _issuance_notice("REJECTED", "WARNING", "Carbon Credit Request Rejected",
                f"concat('Your carbon credit request for ', {_TONNES}, ' tCO2e has been rejected')"),
        ]
    ),
    "notice_payment": _notice(
        "payment_failed", "WARNING", "Payment Failed",
        "concat('Payment ', payment_id, ' failed: ', COALESCE(error, 'null'))",
        "who", 48, "payment-service", "payment_once WHERE reason IS NULL AND status = 'FAILED'",
    ),
}


def over(sql: str) -> str:
    """``sql`` with a WITH list of the tables it needs, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
        for name in TABLES:
            if name in words and name not in needed:
                visit(TABLES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({TABLES[n]})" for n in needed)
    start = sql.lstrip()
    if start.upper().startswith("WITH "):
        return f"WITH {ctes},\n{start[5:]}"
    return f"WITH {ctes}\n{start}"


_ORACLE: dict[str, str] = {}

# ---- messages and intake ----------------------------------------------------

_ORACLE |= {
    "src_route_events": """
SELECT stream, routing_key, COUNT(*) AS messages FROM (
  SELECT 'trade' AS stream, routing_key FROM trade_messages UNION ALL
  SELECT 'payment', routing_key FROM payment_messages UNION ALL
  SELECT 'user', routing_key FROM user_messages UNION ALL
  SELECT 'issuance', routing_key FROM issuance_messages UNION ALL
  SELECT 'user', 'auth.user.updated' FROM supplier) GROUP BY 1, 2""",
    "src_parse_user": """
SELECT event_id AS "eventId", 'USER' AS "eventType", 'auth-service' AS source, sent AS "timestamp",
  correlation AS "correlationId", who AS "userId", username, email, role, region, enabled, action,
  phone AS "phoneNumber",
  CAST(NULL AS VARCHAR) AS "ipAddress", CAST(NULL AS VARCHAR) AS "userAgent", CAST(NULL AS VARCHAR) AS "organizationName", CAST(NULL AS VARCHAR) AS "vehicleMake", CAST(NULL AS VARCHAR) AS "vehicleModel" FROM user_messages""",
    "src_parse_trade": f"""
SELECT event_id AS "eventId", 'TRADE' AS "eventType", 'marketplace-service' AS source, sent AS "timestamp",
  correlation AS "correlationId", who AS "userId", order_id AS "orderId", listing AS "listingId",
  buyer_text AS "buyerId", seller_text AS "sellerId", {num("quantity")} AS quantity, unit AS "quantityUnit",
  {num("unit_price")} AS "unitPrice", {num("amount")} AS amount, currency, status AS "orderStatus",
  status_at AS "statusChangedAt", is_auction AS "isAuction",
  CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS "auctionId" FROM trade_messages""",
    "src_parse_issuance": f"""
SELECT event_id AS "eventId", 'ISSUANCE' AS "eventType", 'carbon-service' AS source, sent AS "timestamp",
  correlation AS "correlationId", who AS "userId", issuance_id AS "issuanceId", request_id AS "requestId",
  vehicle AS "vehicleId", {num("quantity")} AS "quantityTco2e", {num("distance")} AS "distanceKm",
  {num("energy")} AS "energyKwh", {num("avoided")} AS "co2AvoidedKg", status,
  CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS "vehicleMake", CAST(NULL AS VARCHAR) AS "vehicleModel", CAST(NULL AS VARCHAR) AS "vehicleType" FROM issuance_messages""",
    "src_parse_payment": f"""
SELECT event_id AS "eventId", 'PAYMENT' AS "eventType", 'payment-service' AS source, sent AS "timestamp",
  correlation AS "correlationId", who AS "userId", payment_id AS "paymentId", order_id AS "orderId",
  who AS "payerId", {num("amount")} AS amount, 'VND' AS currency, status, method AS "paymentMethod",
  CASE WHEN s = 'O' AND k % 7 <> 0 THEN sent END AS "initiatedAt", CASE WHEN s = 'F' THEN sent END AS "completedAt",
  CASE WHEN s = 'P' THEN sent END AS "failedAt", error AS "errorMessage",
  CAST(NULL AS VARCHAR) AS "payeeId", CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS "errorCode" FROM payment_messages""",
    "scan_fact_window": f"""
SELECT order_id, executed_at, {num("amount")} AS amount FROM fact_trade WHERE executed_at > {ago(30)}""",
    "sink_fact_by_month": """
SELECT 'fact_trade' AS table_name, strftime(executed_at, '%Y-%m') AS month, COUNT(*) AS row_count
  FROM fact_trade GROUP BY 2 UNION ALL
SELECT 'fact_payment', strftime(completed_at, '%Y-%m'), COUNT(*) FROM fact_payment GROUP BY 2 UNION ALL
SELECT 'fact_issuance', strftime(issued_at, '%Y-%m'), COUNT(*) FROM fact_issuance GROUP BY 2 UNION ALL
SELECT 'fact_user_activity', strftime(occurred_at, '%Y-%m'), COUNT(*) FROM fact_user_activity GROUP BY 2""",
    "sink_dead_letter": "SELECT routing_key, stream, reason, event_id FROM dead",
    "sink_payload_json": f"""
SELECT event_id, 'payment' AS stream, correlation, payment_id, {num("amount")} AS amount, status AS shown, sent AS sent_at,
  error AS error_message FROM payment_messages
UNION ALL SELECT event_id, 'trade', correlation, NULL, {num("amount")}, status, sent, NULL FROM trade_messages
UNION ALL SELECT event_id, 'user', correlation, NULL, NULL, action, sent, NULL FROM user_messages
UNION ALL SELECT event_id, 'issuance', correlation, NULL, NULL, status, sent, NULL FROM issuance_messages""",
    "ing_dedup_events": f"""
SELECT DISTINCT event_id, received_at, event_type FROM event_deliveries d
WHERE NOT EXISTS (SELECT 1 FROM consumed_events c WHERE c.event_id = d.event_id AND c.received_at <= {ago(7)})""",
    "ing_mark_consumed": f"""
SELECT event_id, concat(upper(stream), '_EVENT') AS event_type, {AS_OF} AS received_at FROM good""",
    "ing_validate_ids": """
SELECT event_id, buyer_text, CASE WHEN regexp_full_match(buyer_text, '[+-]?[0-9]+')
  THEN CAST(buyer_text AS BIGINT) END AS buyer_id, CAST(seller_text AS BIGINT) AS seller_id, reason
FROM trade_messages""",
    "ing_success_log": f"""
SELECT sha256(concat('log|', event_id)) AS id, 'INFO' AS log_level, source AS source_service,
  CASE stream WHEN 'user' THEN 'USER' ELSE 'BUSINESS' END AS category,
  concat(upper(stream[1]), stream[2:], ' event: ', shown) AS message, correlation AS correlation_id,
  who AS user_id, {AS_OF} AS log_timestamp FROM good""",
    "ing_error_log": f"""
SELECT 'ERROR' AS log_level, 'admin-service' AS source_service, 'SYSTEM' AS category,
  concat('Failed to process ', stream, ' event') AS message, reason AS details, {AS_OF} AS log_timestamp
FROM dead""",
    "ing_event_counters": """
SELECT (SELECT COUNT(*) FROM user_messages WHERE reason IS NULL AND action = 'REGISTERED') AS user_registered,
  (SELECT COUNT(*) FROM user_messages WHERE reason IS NULL AND action = 'LOGGED_IN') AS user_login,
  (SELECT COUNT(*) FROM trade_messages WHERE reason IS NULL AND upper(status) IN ('COMPLETED', 'PENDING_PAYMENT'))
    AS trade_executed,
  (SELECT COUNT(*) FROM issuance_messages WHERE reason IS NULL AND status = 'APPROVED') AS credit_issued,
  (SELECT COUNT(*) FROM payment_messages WHERE reason IS NULL AND upper(status) = 'COMPLETED') AS payment_completed,
  (SELECT COUNT(*) FROM payment_messages WHERE reason IS NULL AND upper(status) = 'FAILED') AS payment_failed,
  (SELECT COUNT(*) FROM dead) AS processing_errors""",
}

# ---- upserts ----------------------------------------------------------------

_LINES = """
WITH e AS (SELECT *, o_orderdate + INTERVAL 8217 DAY AS sent, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS id,
    l_linestatus = 'O' AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, sent ORDER BY late, l_shipdate, id) AS up,
    row_number() OVER (PARTITION BY l_orderkey, sent ORDER BY late DESC, l_shipdate DESC, id DESC) AS down FROM e)"""

_ORACLE |= {
    "upsert_trade": f"""{_LINES}
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, sent AS executed_at, o_custkey AS buyer_id, l_suppkey AS seller_id,
  {num("l_quantity")} AS quantity, {num("l_tax")} AS unit_price, {num("l_extendedprice")} AS amount,
  'tCO2e' AS unit, 'VND' AS currency, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS region,
  l_linestatus AS order_status, false AS is_auction,
  CAST(NULL AS VARCHAR) AS listing_id, CAST(NULL AS TIMESTAMP) AS status_changed_at FROM r WHERE down = 1""",
    "upsert_payment": f"""{_LINES}
SELECT concat('pay-', a.l_orderkey) AS payment_id, a.sent AS completed_at, CAST(a.l_partkey AS VARCHAR) AS order_id,
  {num("a.l_extendedprice")} AS amount, CASE WHEN a.l_suppkey % 2 = 0 THEN 'VND' ELSE 'USD' END AS currency,
  CASE WHEN a.l_suppkey % 3 <> 0 THEN a.l_linestatus END AS payment_method, z.l_returnflag AS status,
  CAST(z.l_suppkey AS VARCHAR) AS payer_id, CASE WHEN z.l_returnflag <> 'N' THEN z.l_returnflag END AS region,
  CAST(NULL AS VARCHAR) AS payee_id, CAST(NULL AS TIMESTAMP) AS status_changed_at
FROM r a JOIN r z ON a.l_orderkey = z.l_orderkey AND a.sent = z.sent WHERE a.up = 1 AND z.down = 1""",
    "upsert_issuance": f"""
WITH e AS (SELECT *, CAST(event_id AS VARCHAR) AS id, date_trunc('day', ts) AS day,
    event_type NOT IN ('view', 'signup') AS late FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY late, ts, id) AS up,
    row_number() OVER (PARTITION BY user_id, day ORDER BY late DESC, ts DESC, id DESC) AS down FROM e)
SELECT concat(CASE WHEN z.user_id % 2 = 0 THEN 'iss-' ELSE 'req-' END, z.user_id) AS issuance_id, z.day AS issued_at,
  z.user_id, CASE WHEN a.event_id % 3 <> 0 THEN concat('req-', a.event_id) END AS request_id,
  {num("z.value")} AS quantity_tco2e, CASE WHEN z.event_id % 5 <> 0 THEN {num("z.value")} END AS energy_kwh,
  z.event_type AS status,
  CAST(NULL AS DOUBLE) AS distance_km, CAST(NULL AS DOUBLE) AS co2_avoided_kg, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS vehicle_id
FROM r a JOIN r z ON a.user_id = z.user_id AND a.day = z.day WHERE a.up = 1 AND z.down = 1""",
}


def _user_fold(actions: str | None) -> str:
    chosen = f"AND action IN ({actions})" if actions else ""
    rows = f"""
  SELECT user_id, username, {_NOTHING} AS email, role, region, enabled, {_NOTHING} AS phone_number,
    'REGISTERED' AS action, 0 AS seq, CAST(NULL AS TIMESTAMP) AS sent, '' AS event_id, created_at,
    CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS TIMESTAMP) AS last_login_at FROM dim_users
  UNION ALL SELECT CAST(who AS BIGINT), username, email, role, region,
    CASE action WHEN 'REGISTERED' THEN COALESCE(enabled, true) WHEN 'DELETED' THEN false ELSE enabled END, phone,
    action, 1, sent, event_id, sent, sent, sent
  FROM user_once WHERE reason IS NULL AND action <> 'ARCHIVED' {chosen}"""
    registered = "action = 'REGISTERED'"
    sets = {
        c: f"{registered} OR (action = 'UPDATED' AND {c} IS NOT NULL)"
        for c in ("username", "email", "role", "region", "phone_number")
    }
    sets["enabled"] = "action IN ('REGISTERED', 'DELETED', 'ENABLED', 'DISABLED')"
    sets["updated_at"] = "true"
    sets["last_login_at"] = "action IN ('REGISTERED', 'LOGGED_IN')"
    last = "".join(
        f""",
v_{c} AS (SELECT user_id, {c} FROM rows_ WHERE {s}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, sent DESC, event_id DESC) = 1)"""
        for c, s in sets.items()
    )
    joins = "".join(f" LEFT JOIN v_{c} USING (user_id)" for c in sets)
    return f"""
WITH rows_ AS ({rows}),
first_ AS (SELECT user_id, created_at FROM rows_ WHERE {registered}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq, sent, event_id) = 1){last}
SELECT user_id, created_at, {", ".join(sets)} FROM first_{joins}"""


_ORACLE |= {
    "dim_users_fold": _user_fold(None),
    "dim_user_registered": _user_fold("'REGISTERED'"),
    "dim_user_logged_in": _user_fold("'LOGGED_IN'"),
    "dim_user_updated": _user_fold("'UPDATED'"),
    "dim_user_deleted": _user_fold("'DELETED'"),
    "dim_user_status": _user_fold("'ENABLED', 'DISABLED'"),
    "activity_append": """
SELECT CAST(who AS BIGINT) AS user_id, action AS event_type, sent AS occurred_at, event_id
FROM user_once WHERE reason IS NULL AND action <> 'ARCHIVED'""",
}

# ---- notices ----------------------------------------------------------------

_ORACLE |= {
    "ntf_user_registered": "SELECT * FROM notice_user",
    "ntf_high_value_trade": "SELECT * FROM notice_trade",
    "ntf_issuance_status": "SELECT * FROM notice_issuance",
    "ntf_payment_failed": "SELECT * FROM notice_payment",
    "ntf_create": f"""
SELECT * FROM notice_user UNION ALL SELECT * FROM notice_trade UNION ALL SELECT * FROM notice_issuance
UNION ALL SELECT * FROM notice_payment UNION ALL
SELECT sha256(concat(id, '|by_hand')), 'ERROR', 'SYSTEM', 'Service error', details, source_service, NULL, false,
  {AS_OF}, CAST(NULL AS TIMESTAMP) FROM system_logs WHERE log_level = 'ERROR'""",
}

# ---- rollups ----------------------------------------------------------------

for _name in ("mv_trades_daily", "mv_issuance_daily", "mv_payments_daily", "mv_user_activity_daily"):
    _ORACLE[_name] = f"SELECT * FROM {_name}"


def _logged(name: str, tick: int) -> str:
    return f"""SELECT '{name}' AS mv_name, {AS_OF} + INTERVAL {tick} SECOND AS refresh_started_at,
  {AS_OF} + INTERVAL {tick + 1} SECOND AS refresh_completed_at, 'SUCCESS' AS status, {_NOTHING} AS error_message,
  COUNT(*) AS rows_affected FROM {name}"""


_VALUES = ("credits_sold", "revenue", "trade_count", "avg_unit_price", "unique_buyers", "unique_sellers")

_ORACLE |= {
    "mv_refresh_one": "SELECT * FROM mv_payments_daily",
    "mv_refresh_all": " UNION ALL ".join(
        _logged(n, 2 * i)
        for i, n in enumerate(
            ("mv_trades_daily", "mv_issuance_daily", "mv_payments_daily", "mv_user_activity_daily")
        )
    ),
    "mv_refresh_diff": f"""
WITH mixed AS (
  SELECT quantity, unit_price, amount, buyer_id, seller_id, executed_at FROM fact_trade
    WHERE order_status <> 'PENDING_PAYMENT' AND executed_at <= {ago(7)} UNION ALL
  SELECT 1, 1, amount, 0, 0, completed_at + INTERVAL 2000 DAY FROM fact_payment),
old AS (SELECT date_trunc('day', executed_at) AS day, {num("SUM(quantity)")} AS credits_sold,
    {num("SUM(amount)")} AS revenue, COUNT(*) AS trade_count,
    ROUND(CAST(SUM(unit_price) AS DOUBLE) / COUNT(*), 6) AS avg_unit_price,
    COUNT(DISTINCT buyer_id) AS unique_buyers, COUNT(DISTINCT seller_id) AS unique_sellers FROM mixed GROUP BY 1)
SELECT COALESCE(n.day, o.day) AS day, {", ".join(f"n.{v}" for v in _VALUES)},
  CASE WHEN o.day IS NULL THEN 'INSERT' WHEN n.day IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change
FROM old o FULL JOIN mv_trades_daily n ON o.day = n.day
WHERE o.day IS NULL OR n.day IS NULL OR {" OR ".join(f"o.{v} <> n.{v}" for v in _VALUES)}""",
    "mv_status": f"""
WITH n AS (SELECT 'mv_trades_daily' AS view_name, COUNT(*) AS row_count FROM mv_trades_daily UNION ALL
  SELECT 'mv_issuance_daily', COUNT(*) FROM mv_issuance_daily UNION ALL
  SELECT 'mv_payments_daily', COUNT(*) FROM mv_payments_daily UNION ALL
  SELECT 'mv_user_activity_daily', COUNT(*) FROM mv_user_activity_daily),
l AS (SELECT mv_name, MAX(refresh_completed_at) AS last_refresh FROM mv_refresh_log WHERE status = 'SUCCESS' GROUP BY 1)
SELECT view_name, row_count, last_refresh, CAST(trunc((epoch_us({AS_OF}) - epoch_us(last_refresh)) / 3600000000.0)
  AS BIGINT) AS hours_since_refresh,
  trunc((epoch_us({AS_OF}) - epoch_us(last_refresh)) / 3600000000.0) > 2 AS is_stale
FROM n LEFT JOIN l ON view_name = mv_name""",
    "mv_refresh_history": """
SELECT * FROM mv_refresh_log ORDER BY refresh_started_at DESC LIMIT 50""",
    "mv_refresh_history_one": """
SELECT refresh_started_at, refresh_completed_at, status, rows_affected, error_message, duration_ms
FROM mv_refresh_log WHERE mv_name = 'mv_issuance_daily' ORDER BY refresh_started_at DESC LIMIT 20""",
    "mv_refresh_stats": f"""
SELECT COUNT(*) AS total_refreshes, COUNT(*) FILTER (status = 'SUCCESS') AS successful,
  COUNT(*) FILTER (status = 'FAILED') AS failed, ROUND(AVG(duration_ms), 6) AS avg_duration_ms
FROM mv_refresh_log WHERE mv_name = 'mv_issuance_daily' AND refresh_started_at > {ago(7)}""",
    "mv_vs_direct": f"""
WITH s AS (SELECT day, trade_count, revenue FROM mv_trades_daily WHERE day > {ago(30)}),
d AS (SELECT date_trunc('day', executed_at) AS day, COUNT(*) AS trade_count, {num("SUM(amount)")} AS revenue
  FROM fact_trade WHERE executed_at > {ago(30)} GROUP BY 1)
SELECT COALESCE(s.day, d.day) AS day, s.trade_count AS rollup_trade_count, d.trade_count AS direct_trade_count,
  s.revenue AS rollup_revenue, d.revenue AS direct_revenue,
  s.trade_count IS NOT DISTINCT FROM d.trade_count AND s.revenue IS NOT DISTINCT FROM d.revenue AS agrees
FROM s FULL JOIN d ON s.day = d.day""",
    "v_regional_co2_stats": "SELECT * FROM co2_stats",
    "v_regional_trade_stats": "SELECT * FROM trade_stats",
    "v_regional_user_stats": "SELECT * FROM user_stats",
}

# ---- reports ----------------------------------------------------------------

_ORACLE |= {
    "overview_counts": """
SELECT (SELECT COUNT(*) FROM dim_users) AS total_users, (SELECT COUNT(*) FROM fact_trade) AS total_trades,
  (SELECT COUNT(*) FROM consumed_events) AS events_processed""",
    "users_by_role": "SELECT role, COUNT(*) AS count FROM dim_users GROUP BY 1",
    "trade_volume_by_currency_all": f"""
SELECT currency, {num("SUM(quantity)")} AS total_quantity, {num("SUM(amount)")} AS total_amount
FROM fact_trade GROUP BY 1""",
    "issuance_totals": f"""
SELECT COUNT(*) AS total_issuances, {num("SUM(quantity_tco2e)")} AS total_tco2e FROM fact_issuance""",
    "recent_activities": f"""
SELECT event_type, user_id, username, occurred_at FROM fact_user_activity LEFT JOIN dim_users USING (user_id)
WHERE occurred_at > {ago(24, "HOUR")} ORDER BY occurred_at DESC, event_type, user_id LIMIT 10""",
    "users_by_region": """
SELECT COALESCE(region, 'Unknown') AS region, count FROM (
  SELECT region, COUNT(*) AS count FROM dim_users GROUP BY region)""",
    "recent_registrations": f"""
SELECT COUNT(*) AS recent_registrations FROM dim_users WHERE created_at > {ago(30)}""",
    "activity_by_type": f"""
SELECT event_type, {big("SUM(event_count)")} AS count, {big("SUM(unique_users)")} AS unique_users
FROM mv_user_activity_daily WHERE day > {ago(7)} GROUP BY 1""",
    "activity_timeline": f"""
SELECT day AS date, event_type, event_count AS count, unique_users
FROM mv_user_activity_daily WHERE day > {ago(7)}""",
    "top_active_users": f"""
SELECT username, role, COUNT(*) AS activity_count FROM fact_user_activity JOIN dim_users USING (user_id)
WHERE occurred_at > {ago(7)} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""",
    "trades_total_window": f"SELECT COUNT(*) AS total_trades FROM fact_trade WHERE executed_at > {ago(30)}",
    "trade_volume_by_currency_90d": f"""
SELECT currency, COUNT(*) AS trade_count, {num("SUM(quantity)")} AS total_quantity,
  {num("SUM(amount)")} AS total_amount FROM fact_trade WHERE executed_at > {ago(90)} GROUP BY 1""",
    "recent_trades": f"""
SELECT order_id, buyer_id, seller_id, {num("quantity")} AS quantity, {num("unit_price")} AS unit_price,
  {num("amount")} AS amount, currency, executed_at FROM fact_trade
ORDER BY executed_at DESC, order_id, buyer_id, seller_id, quantity, unit_price, amount, currency LIMIT 10""",
    "trade_timeline": f"""
SELECT day AS date, trade_count, revenue AS total_amount, avg_unit_price
FROM mv_trades_daily WHERE day > {ago(30)}""",
    "buyer_seller_stats": f"""
SELECT {big("SUM(unique_buyers)")} AS total_unique_buyers, {big("SUM(unique_sellers)")} AS total_unique_sellers
FROM mv_trades_daily WHERE day > {ago(30)}""",
    "issuance_window_totals": f"""
SELECT COUNT(*) AS total_issuances, {num("COALESCE(SUM(quantity_tco2e), 0)")} AS total_tco2e
FROM fact_issuance WHERE issued_at > {ago(30)}""",
    "environmental_impact_90d": f"""
SELECT {num("COALESCE(SUM(distance_km), 0)")} AS total_distance, {num("COALESCE(SUM(energy_kwh), 0)")} AS total_energy,
  {num("COALESCE(SUM(co2_avoided_kg), 0)")} AS total_co2_avoided FROM fact_issuance WHERE issued_at > {ago(90)}""",
    "recent_issuances": f"""
SELECT issuance_id, user_id, {num("quantity_tco2e")} AS quantity_tco2e, {num("distance_km")} AS distance_km,
  {num("energy_kwh")} AS energy_kwh, {num("co2_avoided_kg")} AS co2_avoided_kg, issued_at FROM fact_issuance
ORDER BY issued_at DESC, issuance_id LIMIT 10""",
    "issuance_timeline": f"""
SELECT day AS date, issuance_count AS count, credits_issued AS total_tco2e, avg_issuance
FROM mv_issuance_daily WHERE day > {ago(30)}""",
    "issuance_unique_users": f"""
SELECT {big("SUM(unique_users)")} AS unique_users FROM mv_issuance_daily WHERE day > {ago(30)}""",
    "ts_user_registrations": f"""
SELECT CAST(created_at AS DATE) AS date, COUNT(*) AS count FROM dim_users WHERE created_at > {ago(30)} GROUP BY 1""",
    "ts_trade_volume": f"""
SELECT day AS date, trade_count AS trades, revenue AS volume, credits_sold, avg_unit_price, unique_buyers,
  unique_sellers FROM mv_trades_daily WHERE day > {ago(30)}""",
    "ts_carbon_issuance": f"""
SELECT day AS date, issuance_count AS count, credits_issued AS total_tco2e, avg_issuance, unique_users
FROM mv_issuance_daily WHERE day > {ago(30)}""",
    "ts_event_processing": f"""
SELECT CAST(received_at AS DATE) AS date, COUNT(*) AS count FROM consumed_events
WHERE received_at > {ago(30)} GROUP BY 1""",
    "regional_co2_by_region": f"""
SELECT region, {num("SUM(total_tco2e)")} AS total_tco2e, {num("SUM(total_distance_km)")} AS total_distance_km,
  {num("SUM(total_energy_kwh)")} AS total_energy_kwh, {num("SUM(total_co2_avoided_kg)")} AS total_co2_avoided_kg,
  {big("SUM(issuance_count)")} AS issuance_count FROM co2_stats WHERE date > {ago(30)} GROUP BY 1""",
    "regional_co2_timeline": f"""
SELECT date, region, total_tco2e, issuance_count AS count, total_distance_km, total_co2_avoided_kg
FROM co2_stats WHERE date > {ago(30)}""",
    "regional_revenue_by_region": f"""
SELECT region, currency, {num("SUM(total_amount)")} AS total_revenue, {num("SUM(total_quantity)")} AS total_quantity,
  {big("SUM(trade_count)")} AS trade_count, ROUND(AVG(total_amount / NULLIF(trade_count, 0)), 6) AS avg_trade_value
FROM trade_stats WHERE date > {ago(30)} GROUP BY 1, 2""",
    "regional_revenue_timeline": f"""
SELECT date, region, currency, total_amount AS total_revenue, trade_count, total_quantity
FROM trade_stats WHERE date > {ago(30)}""",
    "regional_transactions": f"""
SELECT COALESCE(region, 'Unknown') AS region, COUNT(*) AS transaction_count,
  {big("SUM(CASE WHEN is_auction THEN 1 ELSE 0 END)")} AS auction_count,
  {big("SUM(CASE WHEN is_auction THEN 0 ELSE 1 END)")} AS fixed_count
FROM fact_trade WHERE executed_at > {ago(30)} GROUP BY 1""",
    "regional_users_by_role": "SELECT region, role, user_count FROM user_stats",
    "regional_users_summary": f"SELECT region, {big('SUM(user_count)')} AS total_users FROM user_stats GROUP BY 1",
    "comp_co2_metrics": f"""
WITH m AS (SELECT {num("COALESCE(SUM(credits_issued), 0)")} AS total_tco2e, COUNT(*) AS total_issuances,
    {big("COALESCE(SUM(unique_users), 0)")} AS unique_contributors FROM mv_issuance_daily WHERE day > {ago(30)}),
f AS (SELECT {num("COALESCE(SUM(distance_km), 0)")} AS total_distance_km,
    {num("COALESCE(SUM(co2_avoided_kg), 0)")} AS total_co2_avoided_kg,
    {num("COALESCE(SUM(energy_kwh), 0)")} AS total_energy_kwh FROM fact_issuance WHERE issued_at > {ago(30)})
SELECT * FROM m, f""",
    "comp_revenue_metrics": f"""
SELECT 'VND' AS currency, {num("COALESCE(SUM(revenue), 0)")} AS total_revenue,
  ROUND(COALESCE(AVG(avg_unit_price), 0), 6) AS avg_price, {big("SUM(trade_count)")} AS trade_count,
  {num("SUM(credits_sold)")} AS total_credits_sold, {big("SUM(unique_buyers)")} AS unique_buyers,
  {big("SUM(unique_sellers)")} AS unique_sellers FROM mv_trades_daily WHERE day > {ago(30)}""",
    "comp_transaction_metrics": f"""
SELECT COUNT(*) AS total_trades, COUNT(listing_id) AS marketplace_trades, COUNT(DISTINCT buyer_id) AS unique_buyers,
  COUNT(DISTINCT seller_id) AS unique_sellers FROM fact_trade WHERE executed_at > {ago(30)}""",
    "comp_user_metrics": """
SELECT role, COUNT(*) AS count, false AS is_total FROM dim_users GROUP BY 1
UNION ALL SELECT NULL, COUNT(*), true FROM dim_users""",
    "comp_regional_breakdown": f"""
SELECT COALESCE(t.region, c.region) AS region, {big("SUM(t.trade_count)")} AS trades,
  {num("SUM(t.total_amount)")} AS revenue, {big("SUM(c.issuance_count)")} AS issuances,
  {num("SUM(c.total_tco2e)")} AS tco2e
FROM trade_stats t FULL JOIN co2_stats c ON t.region = c.region AND t.date = c.date
WHERE t.date > {ago(30)} OR c.date > {ago(30)} GROUP BY 1""",
    "perf_event_metrics": f"""
WITH e AS (SELECT event_type, COUNT(*) AS count, COUNT(*) FILTER (received_at > {ago(24, "HOUR")}) AS count_24h
  FROM consumed_events GROUP BY 1)
SELECT event_type, count, count_24h, false AS is_total FROM e
UNION ALL SELECT NULL, {big("SUM(count)")}, {big("SUM(count_24h)")}, true FROM e""",
    "perf_activity_metrics": f"""
SELECT event_type, COUNT(*) AS count, (SELECT COUNT(*) FROM fact_user_activity) AS total_activities,
  (SELECT COUNT(*) FROM fact_user_activity WHERE occurred_at > {ago(24, "HOUR")}) AS activities_24h
FROM fact_user_activity WHERE occurred_at > {ago(7)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
}

# ---- logs and notifications -------------------------------------------------

_NOTICE_ORDER = "ORDER BY created_at DESC, notification_id"

_ORACLE |= {
    "logs_search": f"""
SELECT * FROM system_logs WHERE log_level = 'ERROR' AND category = 'BUSINESS' AND source_service = 'svc-3'
  AND log_timestamp BETWEEN {ago(7)} AND {AS_OF} ORDER BY log_timestamp DESC, id LIMIT 50""",
    "logs_errors": """
SELECT * FROM system_logs WHERE log_level IN ('ERROR', 'FATAL') ORDER BY log_timestamp DESC, id LIMIT 50""",
    "logs_level_stats": f"""
SELECT COUNT(*) FILTER (log_level = 'DEBUG') AS debug, COUNT(*) FILTER (log_level = 'INFO') AS info,
  COUNT(*) FILTER (log_level = 'WARN') AS warn, COUNT(*) FILTER (log_level = 'ERROR') AS error,
  COUNT(*) FILTER (log_level = 'FATAL') AS fatal FROM system_logs WHERE log_timestamp > {ago(24, "HOUR")}""",
    "logs_by_correlation": f"""
SELECT * FROM system_logs WHERE correlation_id = 'c-42' AND log_timestamp BETWEEN {ago(30)} AND {AS_OF}
ORDER BY log_timestamp, id LIMIT 50""",
    "logs_by_field": """
SELECT * FROM system_logs WHERE source_service = 'svc-1' ORDER BY log_timestamp DESC, id LIMIT 50""",
    "page": f"""
WITH w AS (SELECT id, log_level, log_timestamp FROM system_logs WHERE log_timestamp BETWEEN {ago(7)} AND {AS_OF})
SELECT *, (SELECT COUNT(*) FROM w) AS total FROM w ORDER BY log_timestamp DESC, id LIMIT 25 OFFSET 50""",
    "ntf_for_user": f"""
SELECT * FROM system_notifications WHERE (target_user_id = '42' OR target_user_id IS NULL) AND NOT read_status
{_NOTICE_ORDER} LIMIT 20""",
    "ntf_unread_counts": """
SELECT user_id, (SELECT COUNT(*) FROM system_notifications n WHERE NOT n.read_status
  AND (n.target_user_id = CAST(u.user_id AS VARCHAR) OR n.target_user_id IS NULL)) AS unread FROM dim_users u""",
    "ntf_by_level": f"SELECT * FROM system_notifications WHERE level = 'WARNING' {_NOTICE_ORDER} LIMIT 20",
    "ntf_by_category": f"""
SELECT * FROM system_notifications WHERE category = 'BUSINESS' {_NOTICE_ORDER} LIMIT 20 OFFSET 20""",
    "ntf_stats_by_level": f"""
SELECT level, COUNT(*) AS count FROM system_notifications WHERE created_at > {ago(7)} GROUP BY 1""",
    "ntf_apply_reads": """
WITH one AS (SELECT concat('n-', event_id - 1) AS nid, MIN(ts) AS t FROM events WHERE event_type = 'click' GROUP BY 1),
every AS (SELECT CAST(user_id AS VARCHAR) AS uid, MIN(ts) AS t FROM events
  WHERE event_type = 'view' AND user_id % 3 = 0 GROUP BY 1),
hit AS (SELECT n.*, LEAST(o.t, COALESCE(e.t, CASE WHEN target_user_id IS NULL THEN (SELECT MIN(t) FROM every) END))
    AS t FROM system_notifications n LEFT JOIN one o ON o.nid = n.notification_id
  LEFT JOIN every e ON e.uid = n.target_user_id)
SELECT notification_id, target_user_id, read_status OR t IS NOT NULL AS read_status,
  CASE WHEN NOT read_status THEN t END AS read_at FROM hit""",
    "ntf_by_id_or_target": f"""
SELECT * FROM system_notifications WHERE target_user_id IS NULL AND NOT read_status {_NOTICE_ORDER} LIMIT 20""",
}

# ---- KPIs, health, data quality ---------------------------------------------

_ORPHANS = "(SELECT COUNT(*) FROM fact_user_activity a WHERE NOT EXISTS (SELECT 1 FROM dim_users u WHERE u.user_id = a.user_id))"
_ACTIVE = "(SELECT COUNT(DISTINCT user_id) FROM fact_user_activity)"
_USERS = "(SELECT COUNT(*) FROM dim_users)"

_ORACLE |= {
    "kpi_snapshot": f"""
SELECT {_USERS} AS users, (SELECT COUNT(*) FROM fact_trade) AS trades,
  (SELECT COUNT(*) FROM fact_issuance) AS issuances, (SELECT COUNT(*) FROM consumed_events) AS events,
  (SELECT COUNT(*) FROM fact_user_activity WHERE occurred_at > {TODAY}) AS today_activities,
  (SELECT CAST(floor(SUM(amount)) AS BIGINT) FROM fact_trade) AS trade_volume,
  (SELECT CAST(floor(SUM(quantity_tco2e) * 1000) AS BIGINT) FROM fact_issuance) AS carbon_credits_milli""",
    "kpi_summary": f"""
SELECT {_USERS} AS users, (SELECT COUNT(*) FROM fact_user_activity) AS activities,
  (SELECT COUNT(*) FROM fact_trade) AS trades, (SELECT COUNT(*) FROM fact_issuance) AS issuances,
  (SELECT COUNT(*) FROM consumed_events) AS events_processed, CAST(100.0 AS DOUBLE) AS event_success_rate,
  'VND' AS volume_currency, (SELECT {num("SUM(amount)")} FROM fact_trade) AS volume_total_amount,
  (SELECT {num("SUM(quantity_tco2e)")} FROM fact_issuance) AS total_carbon_credits""",
    "health_events": f"""
SELECT COUNT(*) AS total_events, COUNT(*) FILTER (received_at > {TODAY}) AS events_today FROM consumed_events""",
    "health_latest_event": """
SELECT event_id, received_at FROM consumed_events ORDER BY received_at DESC, event_id LIMIT 1""",
    "health_hourly": f"""
SELECT date_trunc('hour', received_at) AS hour, COUNT(*) AS count FROM consumed_events
WHERE received_at > {ago(24, "HOUR")} GROUP BY 1""",
    "dq_orphaned_activities": f"SELECT {_ORPHANS} AS orphaned_activities",
    "dq_duplicate_events": "SELECT COUNT(*) - COUNT(DISTINCT event_id) AS duplicate_events FROM event_deliveries",
    "dq_activity_coverage": f"""
SELECT {_ACTIVE} AS users_with_activities, {_USERS} AS total_users,
  ROUND(CAST({_ACTIVE} AS DOUBLE) * 100 / {_USERS}, 6) AS activity_coverage""",
    "dq_report": f"""
SELECT {_ORPHANS} AS orphaned_activities,
  (SELECT COUNT(*) - COUNT(DISTINCT event_id) FROM consumed_events) AS duplicate_events,
  {_ACTIVE} AS users_with_activities, {_USERS} AS total_users,
  ROUND(CAST({_ACTIVE} AS DOUBLE) * 100 / {_USERS}, 6) AS activity_coverage,
  CASE WHEN {_ORPHANS} = 0 AND (SELECT COUNT(*) - COUNT(DISTINCT event_id) FROM consumed_events) = 0
    THEN 'HEALTHY' ELSE 'NEEDS_ATTENTION' END AS overall_health""",
}

# ---- maintenance and streaming ----------------------------------------------


def _old_months(fact: str, time: str, keep: int, before: str) -> str:
    return f"""SELECT '{fact}' AS table_name, strftime({time}, '%Y-%m') AS month, {keep} AS retention_months,
  COUNT(*) AS row_count FROM {fact} WHERE {time} < TIMESTAMP '{before}' GROUP BY 2"""


def _missing_months(fact: str, time: str) -> str:
    return f"""SELECT '{fact}' AS table_name, strftime(m, '%Y-%m') AS missing_month
FROM (SELECT unnest(generate_series(date_trunc('month', MIN({time})), TIMESTAMP '2024-02-01', INTERVAL 1 MONTH)) AS m
  FROM {fact}) WHERE strftime(m, '%Y-%m') NOT IN (SELECT strftime({time}, '%Y-%m') FROM {fact})"""


_KNOWN = "user_once WHERE reason IS NULL AND action <> 'ARCHIVED'"

_ORACLE |= {
    "mnt_purge_refresh_log": f"""
SELECT * EXCLUDE (duration_ms) FROM mv_refresh_log WHERE refresh_started_at >= {ago(20)}""",
    "mnt_purge_notifications": f"""
SELECT notification_id, created_at, expires_at FROM system_notifications
WHERE expires_at IS NULL OR expires_at >= {AS_OF}""",
    "mnt_retention_plan": " UNION ALL ".join(
        [
            _old_months("fact_trade", "executed_at", 24, "2022-01-01"),
            _old_months("fact_payment", "completed_at", 24, "2022-01-01"),
            _old_months("fact_issuance", "issued_at", 24, "2022-01-01"),
            _old_months("fact_user_activity", "occurred_at", 12, "2023-01-01"),
        ]
    ),
    "mnt_partition_coverage": _missing_months("fact_trade", "executed_at")
    + " UNION ALL "
    + _missing_months("fact_user_activity", "occurred_at"),
    "mnt_normalize_currency": f"""
SELECT CASE l_returnflag WHEN 'A' THEN 'VND' WHEN 'R' THEN 'EUR' END AS currency, COUNT(*) AS "rows",
  {big("SUM(l_orderkey)")} AS "keys" FROM lineitem GROUP BY 1""",
    "mnt_conform_columns": """
SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS role, concat('org-', c_nationkey) AS organization_name,
  true AS enabled FROM customer""",
    "stream_intake": f"""
SELECT 'fact_trade' AS table_name, (SELECT COUNT(DISTINCT (order_id, sent)) FROM trade_once WHERE reason IS NULL)
  AS row_count UNION ALL
SELECT 'fact_payment', (SELECT COUNT(*) FROM payment_once WHERE reason IS NULL) UNION ALL
SELECT 'fact_issuance', (SELECT COUNT(*) FROM issuance_once) UNION ALL
SELECT 'fact_user_activity', (SELECT COUNT(*) FROM {_KNOWN}) UNION ALL
SELECT 'dim_users', (SELECT COUNT(DISTINCT who) FROM {_KNOWN} AND action = 'REGISTERED') UNION ALL
SELECT 'consumed_events', (SELECT COUNT(*) FROM good) UNION ALL
SELECT 'system_logs', (SELECT COUNT(*) FROM good) + (SELECT COUNT(*) FROM dead) UNION ALL
SELECT 'system_notifications', (SELECT COUNT(*) FROM notice_user) + (SELECT COUNT(*) FROM notice_trade)
  + (SELECT COUNT(*) FROM notice_issuance) + (SELECT COUNT(*) FROM notice_payment) UNION ALL
SELECT 'dead_letters', (SELECT COUNT(*) FROM dead)""",
    "stream_events_daily": "SELECT date_trunc('day', ts) AS start, COUNT(*) AS count FROM events GROUP BY 1",
    "stream_events_hourly": "SELECT date_trunc('hour', ts) AS start, COUNT(*) AS count FROM events GROUP BY 1",
    "stream_events_bounded": """
WITH mark AS (SELECT MAX(ts) - INTERVAL 3 HOUR AS behind FROM events WHERE event_type <> 'error'),
e AS (SELECT date_trunc('hour', ts) AS start, event_type = 'error' AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= behind AS late FROM events, mark)
SELECT start, COUNT(*) FILTER (NOT late) AS kept, COUNT(*) FILTER (late) AS late FROM e GROUP BY 1""",
}


def oracle_sql() -> dict[str, str]:
    return {name: over(sql) for name, sql in _ORACLE.items()}
