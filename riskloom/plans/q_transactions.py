"""Queries over the adapted transactions: scan, validation, features, history."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import scalars as S
from riskloom.operators import validate as V
from riskloom.operators.history import history_features
from riskloom.plans import inputs
from riskloom.plans.catalog import register
from riskloom.plans.sql import D, TXN, base, hist_cte, with_ctes
from riskloom.sources.tables import table

R4, R6 = 4, 6  # output rounding digits (both engines)

# ---------------------------------------------------------------- scan / validate

TXN_COLS = ["txn_id", "account", "nameOrig", "nameDest", "type", "amount", "oldbalanceOrg", "newbalanceOrig",
            "device_type_encoded", "login_attempts", "OTP_flag", "QR_flag", "hour_of_day"]


@register("txn_scan", with_ctes(TXN, body=f"""
SELECT {', '.join(TXN_COLS)}, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM txn"""))
def txn_scan(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    return t.select(*TXN_COLS, F.round("latitude", R6).alias("latitude"), F.round("longitude", R6).alias("longitude"))


def _amount_text(k, amount):
    # derived bad inputs: empty, non-numeric, missing, short decimal, else the value
    return (F.when(k == 0, F.lit("")).when(k == 1, F.lit("abc")).when(k == 2, F.lit(None).cast("string"))
            .when(k == 3, F.lit("12.5")).otherwise(F.format_string("%.2f", amount)))


@register("txn_quarantine", with_ctes(TXN, body="""
, t AS (SELECT txn_id, CASE k WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN NULL WHEN 3 THEN '12.5'
                             ELSE printf('%.2f', amount) END AS amount_text FROM txn)
SELECT txn_id, amount_text, TRY_CAST(amount_text AS DOUBLE) AS amount,
       CAST(TRY_CAST(amount_text AS DOUBLE) IS NOT NULL AS INTEGER) AS is_valid FROM t"""))
def txn_quarantine(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir).select("txn_id", _amount_text(F.col("k"), F.col("amount")).alias("amount_text"))
    return V.with_validity(t).select("txn_id", "amount_text", "amount", "is_valid")


DEFAULT_OUT = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "type",
               "avg_transaction", "account_age", "transactions_per_user", "transactions_last_1hr",
               "device_type_encoded", "device_change_flag", "geo_distance", "impossible_travel_flag",
               "hour_of_day", "is_night_flag", "OTP_flag", "QR_flag", "login_attempts"]


@register("txn_defaults", with_ctes(TXN, body=f"""
, p AS (SELECT txn_id, amount,
          CASE WHEN k % 4 = 0 THEN NULL ELSE oldbalanceOrg END AS ob,
          CASE WHEN k % 3 = 0 THEN NULL ELSE newbalanceOrig END AS nb,
          CASE WHEN k % 5 = 0 THEN NULL ELSE type END AS ty,
          CASE WHEN k % 7 = 0 THEN NULL ELSE device_type_encoded END AS dev,
          login_attempts, OTP_flag,
          CASE WHEN k % 2 = 0 THEN NULL ELSE QR_flag END AS qr,
          CASE WHEN k % 6 = 0 THEN NULL ELSE hour_of_day END AS hr FROM txn)
, d AS (SELECT txn_id, amount, coalesce(ob, amount * 2) AS oldbalanceOrg, nb, ty, dev, login_attempts, OTP_flag, qr, hr
        FROM p)
SELECT txn_id, round(amount, 4) AS amount, round(oldbalanceOrg, 4) AS oldbalanceOrg,
       round(coalesce(nb, oldbalanceOrg - amount), 4) AS newbalanceOrig,
       round({D(10000)}, 4) AS oldbalanceDest, round({D(10000)} + amount, 4) AS newbalanceDest,
       coalesce(ty, 'TRANSFER') AS type, round(amount * {D(0.5)}, 4) AS avg_transaction,
       365 AS account_age, 5 AS transactions_per_user, 1 AS transactions_last_1hr,
       coalesce(dev, 0) AS device_type_encoded, 0 AS device_change_flag, round({D(10)}, 4) AS geo_distance,
       0 AS impossible_travel_flag, coalesce(hr, 12) AS hour_of_day, 0 AS is_night_flag,
       coalesce(OTP_flag, 1) AS OTP_flag, coalesce(qr, 0) AS QR_flag, coalesce(login_attempts, 1) AS login_attempts
FROM d"""))
def txn_defaults(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    k = F.col("k")

    def null_when(cond, c):
        return F.when(cond, F.lit(None)).otherwise(F.col(c)).alias(c)

    payload = t.select(
        "txn_id", "amount",
        null_when(k % 4 == 0, "oldbalanceOrg"), null_when(k % 3 == 0, "newbalanceOrig"),
        null_when(k % 5 == 0, "type"), null_when(k % 7 == 0, "device_type_encoded"),
        "login_attempts", "OTP_flag", null_when(k % 2 == 0, "QR_flag"), null_when(k % 6 == 0, "hour_of_day"),
    )
    d = V.apply_defaults(payload)
    dbl = {"amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "avg_transaction",
           "geo_distance"}
    return d.select("txn_id", *[F.round(c, R4).alias(c) if c in dbl else F.col(c) for c in DEFAULT_OUT])


@register("txn_enriched", with_ctes(TXN, body="""
SELECT t.txn_id, t.account, c.c_nationkey, c.c_mktsegment, t.oldbalanceOrg, t.newbalanceOrig
FROM txn t LEFT JOIN customer c ON t.account = c.c_custkey"""))
def txn_enriched(spark, sf_dir):
    ev = inputs.adapter.event_columns(table(spark, sf_dir, "events"))
    j = inputs.adapter.with_balances(ev, table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")
    return j.select("txn_id", "account", "c_nationkey", "c_mktsegment", "oldbalanceOrg",
                                          "newbalanceOrig")


@register("dedup_rows", with_ctes(TXN, body=f"""
, u AS (SELECT {', '.join(TXN_COLS)} FROM txn UNION ALL SELECT {', '.join(TXN_COLS)} FROM txn WHERE event_type = 'signup')
SELECT DISTINCT * FROM u"""))
def dedup_rows(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    dup = t.unionByName(t.filter(F.col("event_type") == "signup"))
    return V.dedup_rows(dup.select(*TXN_COLS))


@register("clean_nonfinite", with_ctes(TXN, body="""
, x AS (SELECT txn_id, CASE k WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE)
                             WHEN 2 THEN CAST('-inf' AS DOUBLE) WHEN 3 THEN NULL ELSE amount END AS v FROM txn)
SELECT txn_id, round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0 ELSE v END, 4) AS v FROM x"""))
def clean_nonfinite(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    k = F.col("k")
    v = (F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf")))
         .when(k == 3, F.lit(None).cast("double")).otherwise(F.col("amount")))
    return V.clean_nonfinite(t.select("txn_id", v.alias("v")), ["v"]).select("txn_id", F.round("v", R4).alias("v"))


# ---------------------------------------------------------------- features

@register("feat_amount", base("SELECT txn_id, round(log_amount, 6) AS log_amount, large_transaction_flag FROM feat"))
def feat_amount(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    return t.select("txn_id", F.round(S.log_amount("amount"), R6).alias("log_amount"),
                    S.large_flag("amount").alias("large_transaction_flag"))


@register("feat_balance", base("""SELECT txn_id, round(balance_change_org, 4) AS balance_change_org,
    round(balance_change_dest, 4) AS balance_change_dest, round(balance_ratio, 6) AS balance_ratio FROM feat"""))
def feat_balance(spark, sf_dir):
    t = V.apply_defaults(inputs.transactions(spark, sf_dir))
    return t.select("txn_id",
                    F.round(S.balance_change("oldbalanceOrg", "newbalanceOrig"), R4).alias("balance_change_org"),
                    F.round(F.col("newbalanceDest") - F.col("oldbalanceDest"), R4).alias("balance_change_dest"),
                    F.round(S.balance_ratio("amount", "oldbalanceOrg", "batch"), R6).alias("balance_ratio"))


@register("feat_balance_online", with_ctes(TXN, body=f"""
SELECT txn_id, round(least(amount / greatest(oldbalanceOrg, {D(1)}), {D(100)}), 6) AS balance_ratio_online FROM txn"""))
def feat_balance_online(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    return t.select("txn_id", F.round(S.balance_ratio("amount", "oldbalanceOrg", "online"), R6).alias("balance_ratio_online"))


@register("feat_type_code", with_ctes(TXN, body="""
, x AS (SELECT txn_id, CASE WHEN k = 0 THEN 'UNKNOWN' WHEN k = 1 THEN NULL ELSE type END AS ty FROM txn)
SELECT txn_id, ty AS type,
  CAST(CASE ty WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3
               WHEN 'TRANSFER' THEN 4 ELSE 0 END AS INTEGER) AS type_code_batch,
  CAST(CASE ty WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3
               WHEN 'TRANSFER' THEN 4 ELSE 4 END AS INTEGER) AS type_code_online FROM x"""))
def feat_type_code(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    k = F.col("k")
    ty = F.when(k == 0, F.lit("UNKNOWN")).when(k == 1, F.lit(None).cast("string")).otherwise(F.col("type"))
    x = t.select("txn_id", ty.alias("type"))
    return x.select("txn_id", "type", S.type_code("type", "batch").alias("type_code_batch"),
                    S.type_code("type", "online").alias("type_code_online"))


def _hist(spark, sf_dir, velocity=None):
    ev = inputs.adapter.event_columns(table(spark, sf_dir, "events"))
    return history_features(ev, velocity=velocity or inputs.RULE_VELOCITY)


@register("feat_geo", base("""SELECT txn_id, round(prev_latitude, 6) AS prev_latitude,
    round(prev_longitude, 6) AS prev_longitude, round(geo_distance, 4) AS geo_distance, impossible_travel_flag FROM feat"""))
def feat_geo(spark, sf_dir):
    h = _hist(spark, sf_dir)
    return h.select("txn_id", F.round("prev_latitude", R6).alias("prev_latitude"),
                    F.round("prev_longitude", R6).alias("prev_longitude"),
                    F.round("geo_distance", R4).alias("geo_distance"), "impossible_travel_flag")


@register("feat_time", with_ctes(TXN, body="""
SELECT txn_id, hour_of_day, CAST(hour_of_day >= 23 OR hour_of_day <= 5 AS INTEGER) AS is_night_flag FROM txn"""))
def feat_time(spark, sf_dir):
    t = inputs.transactions(spark, sf_dir)
    return t.select("txn_id", "hour_of_day", S.is_night("hour_of_day").alias("is_night_flag"))


@register("feat_behaviour", base("""SELECT txn_id, round(avg_transaction, 4) AS avg_transaction,
    round(deviation_from_avg, 4) AS deviation_from_avg, account_age, transactions_per_user FROM feat"""))
def feat_behaviour(spark, sf_dir):
    h = _hist(spark, sf_dir)
    return h.select("txn_id", F.round("avg_transaction", R4).alias("avg_transaction"),
                    F.round(S.deviation("amount", "avg_transaction"), R4).alias("deviation_from_avg"),
                    "account_age", "transactions_per_user")


@register("feat_device", base("SELECT txn_id, device_type_encoded, device_change_flag FROM feat"))
def feat_device(spark, sf_dir):
    return _hist(spark, sf_dir).select("txn_id", "device_type_encoded", "device_change_flag")


@register("velocity_rows5", base("SELECT txn_id, velocity_rows5 FROM feat"))
def velocity_rows5(spark, sf_dir):
    return _hist(spark, sf_dir).select("txn_id", "velocity_rows5")


@register("velocity_1h", with_ctes(TXN, hist_cte(1), body="SELECT txn_id, transactions_last_1hr AS velocity_1h FROM hist"))
def velocity_1h(spark, sf_dir):
    return _hist(spark, sf_dir, {"velocity_1h": "1 hour"}).select("txn_id", "velocity_1h")


@register("velocity_24h", with_ctes(TXN, hist_cte(24), body="SELECT txn_id, transactions_last_1hr AS velocity_24h FROM hist"))
def velocity_24h(spark, sf_dir):
    return _hist(spark, sf_dir, {"velocity_24h": "24 hours"}).select("txn_id", "velocity_24h")


@register("large_fraud_flag", base("""SELECT txn_id, amount, isFraud,
    CAST(isFraud = 1 AND amount > 200000 AS INTEGER) AS isFlaggedFraud FROM feat"""))
def large_fraud_flag(spark, sf_dir):
    f = inputs.transactions(spark, sf_dir).withColumn(
        "isFraud", inputs.adapter.fixture_label(F.col("amount"), F.col("login_attempts")))
    return f.select("txn_id", "amount", "isFraud", V.large_fraud_flag().alias("isFlaggedFraud"))
