"""Validation and cleaning operators (FLT1-FLT4, FLT7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import nonfinite_to_zero
from riskloom.schemas import ONLINE_TRANSACTION

# --- Fixed values: defaults for a transaction with missing fields ---------------
# Each entry: (column, default value or builder, Spark type).  Order matters: a
# builder receives a resolver that returns the earlier, already defaulted fields.
_DEFAULTS: list[tuple[str, object, str]] = [
    ("amount", 0.0, "double"),
    ("oldbalanceOrg", lambda c: c("amount") * 2, "double"),
    ("newbalanceOrig", lambda c: c("oldbalanceOrg") - c("amount"), "double"),
    ("oldbalanceDest", 10000.0, "double"),
    ("newbalanceDest", lambda c: c("oldbalanceDest") + c("amount"), "double"),
    ("type", "TRANSFER", "string"),
    ("avg_transaction", lambda c: c("amount") * 0.5, "double"),
    ("account_age", 365, "int"),
    ("transactions_per_user", 5, "int"),
    ("transactions_last_1hr", 1, "int"),
    ("device_type_encoded", 0, "int"),
    ("device_change_flag", 0, "int"),
    ("geo_distance", 10.0, "double"),
    ("impossible_travel_flag", 0, "int"),
    ("hour_of_day", 12, "int"),
    ("is_night_flag", 0, "int"),
    ("OTP_flag", 1, "int"),
    ("QR_flag", 0, "int"),
    ("login_attempts", 1, "int"),
]
# Log record defaults.
LOG_DEFAULTS = {"sender_id": "unknown", "receiver_id": "unknown", "amount": 0.0, "fraud_status": "SAFE",
                "risk_score": 0.0, "fraud_probability": 0.0}
# -----------------------------------------------------------------------------

DEFAULT_FIELDS = [name for name, _, _ in _DEFAULTS]


def apply_defaults(df: DataFrame, keep_present: bool = True) -> DataFrame:
    """FLT2: fill missing fields.  A null counts as missing (documented policy);
    absent columns are created.  Derived defaults refer to the already
    defaulted expressions, and everything is one projection."""
    cols = set(df.columns)
    exprs: dict[str, Column] = {}
    for name, default, dtype in _DEFAULTS:
        d = default(exprs.__getitem__) if callable(default) else F.lit(default)
        if name in cols and keep_present:
            exprs[name] = F.coalesce(F.col(name).cast(dtype), d.cast(dtype))
        else:
            exprs[name] = d.cast(dtype)
    return df.select(*[c for c in df.columns if c not in exprs], *[e.alias(n) for n, e in exprs.items()])


# a number as a decimal literal with an optional exponent; no NaN, Infinity or type suffix
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(text) -> Column:
    """The finite number that ``text`` spells, else null."""
    t = F.col(text) if isinstance(text, str) else text
    v = F.when(t.rlike(NUMBER), F.trim(t).try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)


def split_valid(df: DataFrame, amount_text: str = "amount_text") -> tuple[DataFrame, DataFrame]:
    """FLT1: (valid, quarantine) by whether the required amount is a finite number."""
    tagged = df.withColumn("amount", number(amount_text))
    valid = tagged.filter(F.col("amount").isNotNull())
    bad = tagged.filter(F.col("amount").isNull()).withColumn(
        "quarantine_reason",
        F.when(F.col(amount_text).isNull(), F.lit("missing amount")).otherwise(F.lit("unparsable amount")))
    return valid, bad


def with_validity(df: DataFrame, amount_text: str = "amount_text") -> DataFrame:
    """FLT1 as one table: parsed amount plus an is_valid flag (for split sinks)."""
    return df.withColumn("amount", number(amount_text)).withColumn("is_valid", F.col("amount").isNotNull().cast("int"))


def coerce_online(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC4 + SC14: JSON payloads -> typed online transactions.

    Fields are read as text, so a number may come as a number or as a string;
    whole-number fields are truncated; what isn't a finite number counts as
    missing.  ``amount_text`` keeps the required field for FLT1."""
    as_text = ", ".join(f"`{f.name}` string" for f in ONLINE_TRANSACTION)
    rest = [c for c in payloads.columns if c != payload]
    read = payloads.select(*rest, F.from_json(payload, as_text).alias("_t"))
    cols = []
    for f in ONLINE_TRANSACTION:
        v = F.col(f"_t.{f.name}")
        if f.dataType.simpleString() != "string":
            v = number(v)
        if f.dataType.simpleString() == "int":
            v = (F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))).try_cast("int")
        cols.append(v.alias(f.name))
    return read.select(*rest, F.col("_t.amount").alias("amount_text"), *cols)


def clean_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """FLT3: +-inf and NaN and null -> 0 on the given columns."""
    return df.withColumns({c: nonfinite_to_zero(c) for c in cols})


def dedup_rows(df: DataFrame) -> DataFrame:
    """FLT4: drop exact duplicates over all columns (one shuffle, partial agg)."""
    return df.dropDuplicates()


def dedup_counted(df: DataFrame, keys: list[str], keep: str, copies: str = "copies") -> DataFrame:
    """FLT4 with its report: of rows that agree in ``keys`` the one with the smallest ``keep``
    stays, with the number of ``copies`` it stands for (one shuffle, partial agg)."""
    return df.groupBy(*keys).agg(F.min(keep).alias(keep), F.count(F.lit(1)).alias(copies)).select(*[c for c in df.columns if c in keys or c == keep], copies)


def removed_rows(unique: DataFrame, copies: str = "copies") -> DataFrame:
    """(rows, removed) of a result of ``dedup_counted``."""
    return unique.agg(F.coalesce(F.sum(copies), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col(copies) - 1), F.lit(0)).alias("removed"))


def large_fraud_flag(is_fraud: str = "isFraud", amount: str = "amount", at: float = 200000) -> Column:
    """FLT7: known fraud with amount above the flag limit."""
    return ((F.col(is_fraud) == 1) & (F.col(amount) > at)).cast("int")
