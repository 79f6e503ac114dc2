"""Adapter: driver tables ``events`` + ``customer`` -> payment transactions.

The mapping is the fixture contract (FIXTURES.md section 3); every expression is
a plain column expression so the same rows can be produced by a SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.tables import table

# --- Fixed values of the fixture contract -------------------------------------
EVENT_TO_TYPE = {
    "click": "CASH_IN",
    "view": "CASH_OUT",
    "signup": "DEBIT",
    "error": "PAYMENT",
    "purchase": "TRANSFER",
}
AMOUNT_SCALE = 1000.0
BALANCE_SCALE = 20.0
RECEIVERS = 1000
# -----------------------------------------------------------------------------


def _event_type_to_txn_type(c: Column) -> Column:
    out = None
    for ev, ty in EVENT_TO_TYPE.items():
        out = (F.when(c == ev, F.lit(ty)) if out is None else out.when(c == ev, F.lit(ty)))
    return out


def event_columns(events: DataFrame) -> DataFrame:
    """Per-event columns that need no other table (narrow; used by history)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return (
        events.select(
            F.col("event_id").alias("txn_id"),
            F.col("user_id").alias("account"),
            # NTZ -> TIMESTAMP under the UTC session zone (streaming needs TIMESTAMP)
            F.col("ts").cast("timestamp").alias("ts"),
            "event_type",
            k.alias("k"),
            F.round(F.col("value") * F.lit(AMOUNT_SCALE), 2).alias("amount"),
        )
        .withColumns({
            "type": _event_type_to_txn_type(F.col("event_type")),
            "nameOrig": F.concat(F.lit("C"), F.col("account").cast("string")),
            "nameDest": F.concat(F.lit("C"), ((F.col("account") * 7 + F.col("k")) % RECEIVERS).cast("string")),
            "device_type_encoded": (F.col("k") % 3).cast("int"),
            "latitude": F.lit(8.0) + F.col("k") * F.lit(0.29),
            "longitude": F.lit(68.0) + ((F.col("k") * 7) % 100) * F.lit(0.29),
            "login_attempts": (F.lit(1) + F.col("k") % 6).cast("int"),
            "OTP_flag": (F.col("k") % 10 < 7).cast("int"),
            "QR_flag": (F.col("k") % 5 < 2).cast("int"),
            "hour_of_day": F.hour("ts").cast("int"),
        })
    )


def account_balances(customer: DataFrame, *extra: str) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("account"),
        F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * F.lit(BALANCE_SCALE), 2))
        .otherwise(F.lit(0.0)).alias("oldbalanceOrg"),
        *extra,
    )


def with_balances(txn: DataFrame, customer: DataFrame, *extra: str) -> DataFrame:
    """J3: enrich transactions with account attributes.  A transaction of an
    account without a row there stays, with the default balance of twice the amount.

    The dimension side is *not* force-broadcast: Catalyst broadcasts it only when
    its estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (a checked
    bound), otherwise it plans a sort-merge join whose hot-account partitions AQE
    splits (``spark.sql.adaptive.skewJoin.enabled``)."""
    return (
        txn.join(account_balances(customer, *extra), "account", "left")
        .withColumn("oldbalanceOrg", F.coalesce("oldbalanceOrg", F.col("amount") * 2))
        .withColumn("newbalanceOrig", F.greatest(F.col("oldbalanceOrg") - F.col("amount"), F.lit(0.0)))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapted transactions (no history features yet)."""
    ev = event_columns(table(spark, sf_dir, "events"))
    return with_balances(ev, table(spark, sf_dir, "customer"))


def fixture_ml(amount: Column) -> Column:
    return F.round(F.least(amount / F.lit(300000.0), F.lit(1.0)), 4)


def fixture_decision(geo_distance: Column) -> Column:
    return F.round(F.lit(0.4) - F.least(geo_distance / F.lit(3000.0), F.lit(1.0)) * F.lit(0.6), 4)


def fixture_label(amount: Column, login_attempts: Column) -> Column:
    return ((amount > 120000) & (login_attempts >= 5)).cast("int")


def from_raw(raw: DataFrame) -> DataFrame:
    """D1 raw table (``step`` in hours, ``nameOrig`` as account) -> the columns
    the history and feature operators read.  Raw rows carry no id, so the id is
    a hash of the whole row (exact duplicates share it; drop them first, FLT4);
    device and position are absent and stay null (no device change, distance 0)."""
    cols = [F.col(c) for c in raw.columns]
    return raw.select(
        *raw.columns,
        F.xxhash64(*cols).alias("txn_id"),
        F.col("nameOrig").alias("account"),
        F.timestamp_seconds(F.col("step").cast("long") * 3600).alias("ts"),
        F.pmod(F.col("step"), F.lit(24)).cast("int").alias("hour_of_day"),
        F.lit(None).cast("int").alias("device_type_encoded"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
    )
