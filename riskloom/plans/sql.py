"""ANSI SQL (DuckDB dialect) building blocks for the oracle queries.

These restate each operator's meaning with plain account windows over the
given tables; they are an independent check of the Spark plans, not the way
Spark computes them.
"""

from __future__ import annotations


def D(x) -> str:
    """A DOUBLE literal (plain decimals would be exact DECIMAL in DuckDB)."""
    return f"CAST({x} AS DOUBLE)"


TXN = f"""
adapted AS (
  SELECT e.event_id AS txn_id, e.user_id AS account, e.ts AS ts, e.event_type,
         CAST(json_extract(e.props, '$.k') AS INTEGER) AS k,
         round(e.value * {D(1000)}, 2) AS amount,
         CASE WHEN c.c_custkey IS NULL THEN round(e.value * {D(1000)}, 2) * 2 WHEN c.c_acctbal > 0 THEN round(c.c_acctbal * {D(20)}, 2) ELSE {D(0)} END AS oldbalanceOrg
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
),
txn AS (
  SELECT txn_id, account, ts, event_type, k, amount, oldbalanceOrg,
         CASE event_type WHEN 'click' THEN 'CASH_IN' WHEN 'view' THEN 'CASH_OUT' WHEN 'signup' THEN 'DEBIT'
                         WHEN 'error' THEN 'PAYMENT' WHEN 'purchase' THEN 'TRANSFER' END AS type,
         'C' || CAST(account AS VARCHAR) AS nameOrig,
         'C' || CAST((account * 7 + k) % 1000 AS VARCHAR) AS nameDest,
         greatest(oldbalanceOrg - amount, {D(0)}) AS newbalanceOrig,
         CAST(k % 3 AS INTEGER) AS device_type_encoded,
         {D(8)} + k * {D(0.29)} AS latitude,
         {D(68)} + ((k * 7) % 100) * {D(0.29)} AS longitude,
         CAST(1 + k % 6 AS INTEGER) AS login_attempts,
         CAST(k % 10 < 7 AS INTEGER) AS OTP_flag,
         CAST(k % 5 < 2 AS INTEGER) AS QR_flag,
         CAST(hour(ts) AS INTEGER) AS hour_of_day
  FROM adapted
)"""


def _haversine(lat, lng, plat, plng) -> str:
    a = (f"pow(sin(radians({lat} - {plat}) / 2), 2) + cos(radians({lat})) * cos(radians({plat})) "
         f"* pow(sin(radians({lng} - {plng}) / 2), 2)")
    return f"2 * {D(6371)} * asin(sqrt(least(greatest({a}, {D(0)}), {D(1)})))"


HAVERSINE = _haversine


def hist_cte(velocity_hours: int = 24, extra_velocity: dict[str, int] | None = None) -> str:
    extra = "".join(
        f",\n    CAST(count(*) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL {h} HOURS PRECEDING "
        f"AND CURRENT ROW) AS INTEGER) AS {name}" for name, h in (extra_velocity or {}).items())
    return f"""
hist AS (
  SELECT *,
    CAST(row_number() OVER w AS INTEGER) AS transactions_per_user,
    CAST(count(*) OVER (PARTITION BY account ORDER BY ts RANGE BETWEEN INTERVAL {velocity_hours} HOURS PRECEDING
                        AND CURRENT ROW) AS INTEGER) AS transactions_last_1hr{extra},
    lag(device_type_encoded) OVER w AS prev_device,
    lag(latitude) OVER w AS plat,
    lag(longitude) OVER w AS plng,
    avg(amount) OVER (PARTITION BY account ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_avg,
    min(ts) OVER (PARTITION BY account) AS first_ts
  FROM txn
  WINDOW w AS (PARTITION BY account ORDER BY ts, txn_id)
),
feat0 AS (
  SELECT *,
    CAST(least(transactions_per_user, 5) AS INTEGER) AS velocity_rows5,
    CAST(CASE WHEN prev_device IS NULL THEN 0 WHEN device_type_encoded <> prev_device THEN 1 ELSE 0 END AS INTEGER)
      AS device_change_flag,
    coalesce(plat, latitude) AS prev_latitude,
    coalesce(plng, longitude) AS prev_longitude,
    CASE WHEN plat IS NULL THEN {D(0)} ELSE {_haversine('latitude', 'longitude', 'plat', 'plng')} END AS geo_distance,
    coalesce(prev_avg, amount * {D(0.5)}) AS avg_transaction,
    CAST(date_diff('day', CAST(first_ts AS DATE), CAST(ts AS DATE)) AS INTEGER) AS account_age
  FROM hist
),
feat AS (
  SELECT *,
    ln(1 + amount) AS log_amount,
    CAST(amount > 50000 AS INTEGER) AS large_transaction_flag,
    oldbalanceOrg - newbalanceOrig AS balance_change_org,
    (CAST(10000 AS DOUBLE) + amount) - CAST(10000 AS DOUBLE) AS balance_change_dest,
    least(greatest(CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE {D(0)} END, {D(0)}), {D(100)})
      AS balance_ratio,
    CAST(CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3
                   WHEN 'TRANSFER' THEN 4 ELSE 0 END AS INTEGER) AS type_encoded,
    CAST(hour_of_day >= 23 OR hour_of_day <= 5 AS INTEGER) AS is_night_flag,
    CAST(geo_distance > 500 AS INTEGER) AS impossible_travel_flag,
    abs(amount - avg_transaction) AS deviation_from_avg,
    round(least(amount / {D(300000)}, {D(1)}), 4) AS ml_probability,
    round({D(0.4)} - least(geo_distance / {D(3000)}, {D(1)}) * {D(0.6)}, 4) AS anomaly_decision,
    CAST(amount > 120000 AND login_attempts >= 5 AS INTEGER) AS isFraud
  FROM feat0
)"""


# --- rules (same order, weights and texts as riskloom.operators.rules) ------------
RULES = [
    ("R1a", "amount > 100000", 0.25, "'High transaction amount (>₹1,00,000)'"),
    ("R1b", "amount <= 100000 AND amount > 50000", 0.15, "'Large transaction amount (>₹50,000)'"),
    ("R2", "transactions_last_1hr > 5", 0.2,
     "'High velocity: ' || CAST(transactions_last_1hr AS VARCHAR) || ' transactions in 1hr window'"),
    ("R3", "device_change_flag = 1", 0.2, "'Recent device change detected'"),
    ("R4", "impossible_travel_flag = 1", 0.3,
     "'Impossible travel detected (distance: ' || printf('%.0f', round(geo_distance, 0)) || ' km)'"),
    ("R5", "is_night_flag = 1", 0.1, "'Transaction during unusual hours (11PM–5AM)'"),
    ("R6", "account_age < 30 AND amount > 25000", 0.2,
     "'New account (' || CAST(account_age AS VARCHAR) || ' days) with large transaction'"),
    ("R7", "login_attempts >= 4", 0.2,
     "'Suspicious login pattern (' || CAST(login_attempts AS VARCHAR) || ' attempts)'"),
    ("R8", "deviation_from_avg > avg_transaction * 3", 0.15, "'Transaction amount significantly above user average'"),
    ("R9", "QR_flag = 1 AND device_change_flag = 1", 0.15, "'QR code transaction from a new device'"),
    ("R10", "balance_ratio > 0.9", 0.2, "'Transaction drains >90% of account balance'"),
]


def _rule_score() -> str:
    s = D(0)
    for _, cond, w, _ in RULES:
        s = f"({s} + CASE WHEN {cond} THEN {D(w)} ELSE {D(0)} END)"
    return f"least({s}, {D(1)})"


def _rule_reasons() -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN {msg} END" for _, cond, _, msg in RULES)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


SCORED = f"""
ruled AS (
  SELECT *, {_rule_score()} AS rule_score, {_rule_reasons()} AS rule_reasons,
         least(greatest({D(0.5)} - anomaly_decision, {D(0)}), {D(1)}) AS anomaly_score
  FROM feat
),
scored0 AS (
  SELECT *, round(least(ml_probability * {D(0.5)} + anomaly_score * {D(0.2)} + rule_score * {D(0.3)}, {D(1)}), 4)
              AS fraud_probability
  FROM ruled
),
scored AS (
  SELECT *, round(fraud_probability * 100, 1) AS risk_score,
    CASE WHEN fraud_probability >= 0.6 THEN 'FRAUD' WHEN fraud_probability >= 0.3 THEN 'SUSPICIOUS' ELSE 'SAFE' END
      AS fraud_label,
    CASE WHEN len(list_concat(list_filter([
           CASE WHEN anomaly_score > 0.5 THEN 'Anomaly detection flags unusual pattern (score: '
                || printf('%.2f', round(anomaly_score, 2)) || ')' END,
           CASE WHEN ml_probability > 0.5 THEN 'ML model flags high fraud probability ('
                || printf('%.1f', round(ml_probability * 100, 1)) || '%)' END], lambda x: x IS NOT NULL),
           rule_reasons)) = 0 THEN ['No risk factors detected']
         ELSE list_concat(list_filter([
           CASE WHEN anomaly_score > 0.5 THEN 'Anomaly detection flags unusual pattern (score: '
                || printf('%.2f', round(anomaly_score, 2)) || ')' END,
           CASE WHEN ml_probability > 0.5 THEN 'ML model flags high fraud probability ('
                || printf('%.1f', round(ml_probability * 100, 1)) || '%)' END], lambda x: x IS NOT NULL),
           rule_reasons) END AS reasons
  FROM scored0
),
log AS (
  SELECT txn_id AS id, nameOrig AS sender_id, nameDest AS receiver_id, amount, fraud_label AS fraud_status,
         risk_score, fraud_probability, reasons, ts AS created_at
  FROM scored
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def base(body: str, velocity_hours: int = 24, extra_velocity: dict[str, int] | None = None) -> str:
    """txn + hist + feat + scored CTEs, then ``body``."""
    return with_ctes(TXN, hist_cte(velocity_hours, extra_velocity), SCORED, body=body)
