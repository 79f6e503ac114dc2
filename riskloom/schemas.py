"""Declared schemas and fixed constants shared by batch and streaming code."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values that must equal the scored system's (do not reorder) ---------
# Model feature vector, in training order.
FEATURE_COLUMNS = [
    "log_amount",
    "large_transaction_flag",
    "balance_ratio",
    "type_encoded",
    "transactions_per_user",
    "transactions_last_1hr",
    "device_type_encoded",
    "device_change_flag",
    "geo_distance",
    "impossible_travel_flag",
    "avg_transaction",
    "account_age",
    "hour_of_day",
    "is_night_flag",
    "OTP_flag",
    "QR_flag",
    "login_attempts",
]
LABEL_COLUMN = "isFraud"

# Transaction type codes.
TYPE_CODES = {"CASH_IN": 0, "CASH_OUT": 1, "DEBIT": 2, "PAYMENT": 3, "TRANSFER": 4}
TYPE_UNKNOWN_BATCH = 0
TYPE_UNKNOWN_ONLINE = 4

# Labels, in descending severity.
FRAUD, SUSPICIOUS, SAFE = "FRAUD", "SUSPICIOUS", "SAFE"
STATUSES = [FRAUD, SUSPICIOUS, SAFE]
# -----------------------------------------------------------------------------

RAW_TRANSACTION = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])

# One online transaction: every field optional except amount (validated later).
ONLINE_TRANSACTION = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in (
        "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
        "avg_transaction", "geo_distance")]
    + [T.StructField("type", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in (
        "account_age", "transactions_per_user", "transactions_last_1hr", "hour_of_day",
        "login_attempts", "device_type_encoded", "device_change_flag",
        "impossible_travel_flag", "is_night_flag", "OTP_flag", "QR_flag")]
)

SCORED_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sender_id", T.StringType()),
    T.StructField("receiver_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("fraud_status", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampType()),
])

CONFUSION = T.StructType([T.StructField(n, T.LongType()) for n in ("TP", "TN", "FP", "FN")])
MODEL_METRICS = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("confusion_matrix", CONFUSION),
    T.StructField("type", T.StringType()),
])
METRICS_DOCUMENT = T.StructType([
    T.StructField("models", T.MapType(T.StringType(), MODEL_METRICS)),
    T.StructField("feature_importance", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("primary_model", T.StringType()),
    T.StructField("feature_columns", T.ArrayType(T.StringType())),
    T.StructField("training_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
    T.StructField("fraud_ratio", T.DoubleType()),
])
