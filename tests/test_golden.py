"""Golden rows: the example transactions and each rule at its threshold."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.features import scalar_features
from riskloom.operators.scoring import score
from riskloom.operators.validate import apply_defaults
from riskloom.schemas import ONLINE_TRANSACTION


def _score_online(spark, rows, ml=0.0, decision=0.5):
    df = spark.createDataFrame(rows, ONLINE_TRANSACTION)
    f = scalar_features(apply_defaults(df), "online")
    f = f.withColumns({"ml_probability": F.lit(ml), "anomaly_decision": F.lit(decision)})
    return score(f)


def _row(**kw):
    base = {f.name: None for f in ONLINE_TRANSACTION.fields}
    base.update(kw)
    return base


EXAMPLES = [
    # (payload, expected rule_score)
    (dict(amount=500.0, type="PAYMENT", account_age=730, avg_transaction=450.0, login_attempts=1,
          device_change_flag=0, is_night_flag=0, QR_flag=0), 0.0),
    (dict(amount=250000.0, type="TRANSFER", account_age=5, avg_transaction=2000.0, login_attempts=5,
          device_change_flag=1, is_night_flag=1, impossible_travel_flag=1, geo_distance=2000.0,
          transactions_last_1hr=8, QR_flag=1), 1.0),
    (dict(amount=1500.0, type="PAYMENT", avg_transaction=1200.0, account_age=730), 0.0),
    (dict(amount=75000.0, type="CASH_OUT", avg_transaction=8000.0, account_age=30, login_attempts=3,
          transactions_last_1hr=5, geo_distance=350.0, is_night_flag=1, device_change_flag=1, QR_flag=1), 0.75),
    (dict(amount=250000.0, type="CASH_OUT", avg_transaction=2000.0, account_age=7, login_attempts=6,
          transactions_last_1hr=8, geo_distance=2500.0, impossible_travel_flag=1, is_night_flag=1,
          device_change_flag=1, QR_flag=1), 1.0),
]


@pytest.mark.parametrize("payload,expected", EXAMPLES)
def test_examples(spark, payload, expected):
    r = _score_online(spark, [_row(**payload)]).first()
    assert r["rule_score"] == pytest.approx(expected)


def test_labels_at_boundaries(spark):
    fraud_ex = _row(**EXAMPLES[1][0])
    r = _score_online(spark, [fraud_ex]).first()
    # ml = anomaly = 0 (decision 0.5): p = 0.3 -> SUSPICIOUS, boundary included
    assert r["fraud_probability"] == pytest.approx(0.3)
    assert r["fraud_label"] == "SUSPICIOUS"
    r = _score_online(spark, [_row(**EXAMPLES[3][0])]).first()
    assert r["fraud_probability"] == pytest.approx(0.225)
    assert r["fraud_label"] == "SAFE"
    assert r["reasons"][0].startswith("Large transaction amount")


@pytest.mark.parametrize("amount,r1a,r1b", [(50000.0, 0, 0), (50000.01, 0, 1), (100000.0, 0, 1),
                                             (100000.01, 1, 0)])
def test_amount_rule_edges(spark, amount, r1a, r1b):
    from riskloom.operators.rules import rule_flags
    df = apply_defaults(spark.createDataFrame([_row(amount=amount)], ONLINE_TRANSACTION))
    r = rule_flags(scalar_features(df, "online")).first()
    assert (r["hit_R1a"], r["hit_R1b"]) == (r1a, r1b)


@pytest.mark.parametrize("field,value,rule,hit", [
    ("transactions_last_1hr", 5, "R2", 0), ("transactions_last_1hr", 6, "R2", 1),
    ("login_attempts", 3, "R7", 0), ("login_attempts", 4, "R7", 1),
    ("geo_distance", 500.0, "R4", 0),
])
def test_rule_edges(spark, field, value, rule, hit):
    from riskloom.functions.scalars import impossible_travel
    from riskloom.operators.rules import rule_flags
    df = apply_defaults(spark.createDataFrame([_row(amount=1000.0, **{field: value})], ONLINE_TRANSACTION))
    df = scalar_features(df, "online")
    if field == "geo_distance":
        df = df.withColumn("impossible_travel_flag", impossible_travel("geo_distance"))
    assert rule_flags(df).first()[f"hit_{rule}"] == hit


def test_age_rule_edges(spark):
    from riskloom.operators.rules import rule_flags
    rows = [_row(amount=30000.0, account_age=29), _row(amount=30000.0, account_age=30),
            _row(amount=25000.0, account_age=1), _row(amount=25000.01, account_age=1)]
    df = scalar_features(apply_defaults(spark.createDataFrame(rows, ONLINE_TRANSACTION)), "online")
    assert [r["hit_R6"] for r in rule_flags(df).collect()] == [1, 0, 0, 1]


def test_night_and_ratio_edges(spark):
    from riskloom.functions.scalars import balance_ratio, is_night
    df = spark.createDataFrame([(h,) for h in (5, 6, 22, 23)], "h int")
    assert [r[0] for r in df.select(is_night("h")).collect()] == [1, 0, 0, 1]
    df = spark.createDataFrame([(0.9, 1.0), (0.9001, 1.0), (5.0, 0.0), (5.0, 0.5)], "a double, o double")
    rows = df.select(balance_ratio("a", "o", "batch").alias("b"), balance_ratio("a", "o", "online").alias("o")).collect()
    assert [r["b"] for r in rows] == [0.9, 0.9001, 0.0, 10.0]
    assert [r["o"] for r in rows] == [0.9, 0.9001, 5.0, 5.0]


def test_missing_fields_defaults(spark):
    r = apply_defaults(spark.createDataFrame([_row(amount=100.0)], ONLINE_TRANSACTION)).first()
    assert (r["oldbalanceOrg"], r["newbalanceOrig"], r["oldbalanceDest"], r["newbalanceDest"]) == (200.0, 100.0, 10000.0, 10100.0)
    assert (r["type"], r["avg_transaction"], r["account_age"], r["OTP_flag"], r["login_attempts"]) == ("TRANSFER", 50.0, 365, 1, 1)


def test_risk_and_label_disagree_near_boundary(spark):
    from riskloom.operators.scoring import label, risk_band, risk_score
    df = spark.createDataFrame([(0.5995,)], "p double")
    r = df.select(risk_score("p").alias("r"), label("p").alias("l")).select("r", "l", risk_band("r").alias("b")).first()
    assert (r["r"], r["l"], r["b"]) == (60.0, "SUSPICIOUS", "danger")


def test_quarantine(spark):
    from riskloom.operators.validate import split_valid
    df = spark.createDataFrame([("",), ("abc",), (None,), ("12.5",), ("-3",)], "amount_text string")
    valid, bad = split_valid(df)
    assert sorted(r["amount"] for r in valid.collect()) == [-3.0, 12.5]
    assert bad.count() == 3


def test_prediction_record(spark):
    rows = [_row(**EXAMPLES[1][0])]
    s = _score_online(spark, rows, ml=0.9, decision=-0.2)
    from riskloom.operators.scoring import prediction_record
    rec = prediction_record(s.withColumn("txn_id", F.lit(1)),
                            [("login_attempts", 0.3577), ("transactions_per_user", 0.3256), ("QR_flag", 0.01)]).first()
    p = rec["prediction"]
    assert p["fraud_label"] == "FRAUD" and p["ml_prediction"] == 1
    assert p["reasons"][0].startswith("Anomaly detection flags unusual pattern (score: 0.70)")
    assert p["reasons"][1] == "ML model flags high fraud probability (90.0%)"
    assert max(p["feature_importance"].items(), key=lambda kv: kv[1])[0] == "login_attempts"
    assert len(p["feature_importance"]) == 3
    assert p["features_used"]["login_attempts"] == 5.0
