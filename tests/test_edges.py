"""Edge inputs: null scores, tiny quantile limits, unknown accounts, replays, rows out of order."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.text import number_text
from riskloom.operators.evaluation import roc_auc, roc_points
from riskloom.operators.ledger import append_log
from riskloom.operators.ranking import exact_quantile
from riskloom.sources.adapter import with_balances


def test_auc_and_points_with_null_scores(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.10001), (0, 0.10002), (1, None), (0, float("nan")), (None, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    # of the 2 x 3 pairs: five won, one tied
    assert roc_auc(df).first()["roc_auc"] == pytest.approx(5.5 / 6)
    pts = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in roc_points(df, ranges=2).collect())
    assert [p[0] for p in pts] == [0.10001, 0.10002, 0.8, 0.9, float("inf")]
    assert pts[0][1:] == (1.0, 1.0) and pts[-1][1:] == (0.0, 0.0) and pts[2][1:] == (pytest.approx(1 / 3), 1.0)


@pytest.mark.parametrize("q", [0.0, 0.1, 247.5 / 999, 0.5, 0.987, 1.0])
def test_quantile_at_tiny_limits(spark, q):
    values = [float((i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_quantile(df, "v", q, ranges=4, max_local=10) == pytest.approx(np.quantile(values, q))


def test_amount_text(spark):
    values = [12345678.9, 0.0001, 1e20, 100.0, 99.9, 0.0, None, 51.95]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["t"] for r in df.orderBy("i").select(number_text("v").alias("t")).collect()]
    assert got == ["12345678.9", "0.0001", "100000000000000000000", "100", "99.9", "", "", "51.95"]


def test_unknown_accounts_stay(spark):
    txn = spark.createDataFrame([(1, 10, 50.0), (2, 11, 70.0), (3, None, 5.0)], "txn_id long, account long, amount double")
    cust = spark.createDataFrame([(10, 100.0, 1, "x")], "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string")
    got = {r["txn_id"]: (r["oldbalanceOrg"], r["newbalanceOrig"]) for r in with_balances(txn, cust).collect()}
    assert got == {1: (2000.0, 1950.0), 2: (140.0, 70.0), 3: (10.0, 5.0)}


def test_append_is_idempotent_across_dates(spark, scratch):
    day = dt.datetime(2024, 3, 1, 12)
    rec = "id long, amount double, created_at timestamp"
    first = spark.createDataFrame([(1, 5.0, day), (2, 6.0, day), (2, 7.0, day - dt.timedelta(hours=1))], rec)
    again = spark.createDataFrame([(1, 5.0, day + dt.timedelta(days=2)), (3, 1.0, None)], rec)
    assert append_log(first, f"{scratch}/log") == 2
    assert append_log(again, f"{scratch}/log") == 1
    assert append_log(again, f"{scratch}/log") == 0
    got = {r["id"]: r["amount"] for r in spark.read.parquet(f"{scratch}/log").collect()}
    assert got == {1: 5.0, 2: 7.0, 3: 1.0}
