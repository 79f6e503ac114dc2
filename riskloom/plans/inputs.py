"""Shared Spark inputs for the registered queries (all read the given tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.features import scalar_features
from riskloom.operators.history import history_features
from riskloom.operators.logstore import LogStore
from riskloom.operators.validate import apply_defaults
from riskloom.operators.scoring import score
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import adapter
from riskloom.sources.tables import cached, table

# part of the stored log's key: to be raised when features, rules or scores change
LOG_VERSION = "1"
# velocity over 24 hours feeds the rule input so that the velocity rule can fire
RULE_VELOCITY = {"transactions_last_1hr": "24 hours"}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.transactions(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    # history needs only event columns; the account dimension is joined once, afterwards
    ev = adapter.event_columns(table(spark, sf_dir, "events"))
    hist = history_features(ev, velocity=RULE_VELOCITY)
    f = scalar_features(apply_defaults(adapter.with_balances(hist, table(spark, sf_dir, "customer"))), "batch")
    return f.withColumns({
        "ml_probability": adapter.fixture_ml(F.col("amount")),
        "anomaly_decision": adapter.fixture_decision(F.col("geo_distance")),
        "isFraud": adapter.fixture_label(F.col("amount"), F.col("login_attempts")),
    })


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_id and fixture label alone: a narrow scan of events, without history."""
    ev = adapter.event_columns(table(spark, sf_dir, "events"))
    return ev.select("txn_id", adapter.fixture_label(F.col("amount"), F.col("login_attempts")).alias("isFraud"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(features(spark, sf_dir))


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored adapter as the transaction log (D7)."""
    return scored(spark, sf_dir).select(
        F.col("txn_id").alias("id"),
        F.col("nameOrig").alias("sender_id"),
        F.col("nameDest").alias("receiver_id"),
        "amount",
        F.col("fraud_label").alias("fraud_status"),
        "risk_score",
        "fraud_probability",
        "reasons",
        F.col("ts").alias("created_at"),
    )


def stored_log(spark: SparkSession, sf_dir: str) -> LogStore:
    """D7 as a stored log: scored and written once for each state of the input tables, read by
    every log and statistics query (a folder beside the checkpoints holds it)."""
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("events", "customer")]
    root = f"{ensure_checkpoint_dir(spark)}/stored-log"
    return LogStore(spark, cached(spark, root, paths, LOG_VERSION, lambda out: LogStore(spark, out).append(scored_log(spark, sf_dir))))


# ---- events as they arrive

REPLAY_BATCHES = 4


def arrival(very_late: bool):
    """When an event arrives: up to 49 minutes after its time; with ``very_late`` a part of them ten days later."""
    minutes = (F.col("k") * 7) % 50 + (F.when(F.col("k") % 20 == 3, 10 * 24 * 60).otherwise(0) if very_late else F.lit(0))
    return F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + minutes.cast("long") * 60_000_000)


def arrival_sql(very_late: bool) -> str:
    """``arrival`` over the oracle's ``txn``."""
    late = " + CASE WHEN k % 20 = 3 THEN 14400 ELSE 0 END" if very_late else ""
    return f"ts + to_minutes(CAST((k * 7) % 50{late} AS BIGINT))"


def replay(spark: SparkSession, sf_dir: str, path: str, go_on, very_late: bool = False) -> None:
    """Write the events under ``path`` in REPLAY_BATCHES spans of their arrival, and call ``go_on`` after each."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    came = events.withColumn("k", k).withColumn("_us", F.unix_micros(arrival(very_late)))
    lo, hi = came.agg(F.min("_us"), F.max("_us")).first()
    if lo is None:
        lo = hi = 0
    part = F.floor((F.coalesce("_us", F.lit(lo)) - F.lit(lo)) * REPLAY_BATCHES / F.lit(hi - lo + 1))
    for i in range(REPLAY_BATCHES):
        came.filter(part == i).select(*events.columns).write.mode("append").parquet(path)
        go_on()


def stream_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
