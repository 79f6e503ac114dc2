"""Model operators: evaluation parity, persistence, anomaly ranking, CV."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import evaluation as EV
from riskloom.operators import models as M
from riskloom.operators.anomaly import fit_iforest, score_iforest
from riskloom.plans import inputs
from riskloom.schemas import FEATURE_COLUMNS
from riskloom.sources.tables import read_metrics
from tests.conftest import SF_SMALL


def test_auc_matches_spark_evaluator(spark):
    s = inputs.scored(spark, SF_SMALL).select(F.col("isFraud").cast("double").alias("label"),
                                               F.col("fraud_probability").alias("score"))
    ours = EV.roc_auc(s.withColumn("label", F.col("label").cast("int"))).first()["roc_auc"]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                           metricName="areaUnderROC").evaluate(s)
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_leakage_order_and_oversampling(spark):
    frame = M.training_frame(inputs.features(spark, SF_SMALL))
    train, test, stats = M.prepare(frame)
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert counts[1] == int(np.floor(0.5 * counts[0]))
    # test rows are original rows only, disjoint from train
    assert test.filter(F.col("txn_id") < 0).count() == 0
    assert train.join(test, "txn_id", "left_semi").count() == 0
    # scaler fitted on train rows only: train (original rows) is standardised
    m = train.filter(F.col("txn_id") >= 0).agg(F.avg("log_amount")).first()[0]
    assert m == pytest.approx(0.0, abs=1e-9)


def test_models_save_load_same_scores(spark, scratch):
    frame = M.training_frame(inputs.features(spark, SF_SMALL))
    train, test, stats = M.prepare(frame)
    lr = M.fit_lr(train)
    rf = M.fit_rf(train, trees=20, depth=6)
    iso = fit_iforest(train.filter(F.col("txn_id") >= 0), FEATURE_COLUMNS, trees=30)
    M.save_models(scratch, lr=lr, rf=rf, iforest=iso, scaler=stats, spark=spark)
    got = M.load_models(spark, scratch)
    a = M.predict(rf, test).orderBy("txn_id").collect()
    b = M.predict(got["rf"], test).orderBy("txn_id").collect()
    assert [r["probability"] for r in a] == [r["probability"] for r in b]
    a = score_iforest(spark, test, iso).orderBy("txn_id").collect()
    b = score_iforest(spark, test, got["iforest"]).orderBy("txn_id").collect()
    assert [r["iforest_score"] for r in a] == pytest.approx([r["iforest_score"] for r in b])
    assert got["scaler"].keys() == stats.keys()


def test_iforest_ranks_planted_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    x[:10] += 8.0
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "txn_id long, a double, b double, c double")
    model = fit_iforest(df, ["a", "b", "c"], trees=100, contamination=0.005)
    s = score_iforest(spark, df, model).orderBy(F.col("iforest_score").desc()).limit(10).collect()
    assert {r["txn_id"] for r in s} == set(range(10))


def test_metrics_document_roundtrip(spark, scratch):
    doc = M.metrics_document(
        spark, {"Random Forest": {"accuracy": 0.9992, "precision": 0.9486, "recall": 0.9942, "f1_score": 0.9709,
                                  "roc_auc": 1.0, "confusion_matrix": {"TP": 517, "TN": 39452, "FP": 28, "FN": 3}},
                "Isolation Forest": {"accuracy": 0.9885, "precision": 0.5579, "recall": 0.5654, "f1_score": 0.5616,
                                     "roc_auc": None, "type": "anomaly_detection"}},
        [("login_attempts", 0.3577)], primary="Random Forest", training_samples=236880, test_samples=40000,
        fraud_ratio=0.013)
    M.write_metrics(doc, scratch + "/metrics")
    back = read_metrics(spark, scratch + "/metrics").first()
    assert back["models"]["Random Forest"]["confusion_matrix"]["TP"] == 517
    assert back["models"]["Isolation Forest"]["roc_auc"] is None
    assert back["feature_columns"] == FEATURE_COLUMNS


def test_confusion_metrics_reproduce_published_rows(spark):
    # each supervised row of the published metrics follows from its confusion matrix
    rows = [("lr", 518, 39316, 164, 2, 0.9959, 0.7595, 0.9962, 0.8619),
            ("rf", 517, 39452, 28, 3, 0.9992, 0.9486, 0.9942, 0.9709),
            ("svm", 515, 39392, 88, 5, 0.9977, 0.8541, 0.9904, 0.9172)]
    cm = spark.createDataFrame([r[:5] for r in rows], "model string, TP long, TN long, FP long, FN long")
    got = {r["model"]: r for r in EV.metrics_from_confusion(cm).collect()}
    for m, *_, acc, prec, rec, f1 in rows:
        assert (got[m]["accuracy"], got[m]["precision"], got[m]["recall"], got[m]["f1_score"]) == (acc, prec, rec, f1)


def test_training_rows_are_in_equal_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "SMALL_ROWS", 100)
    monkeypatch.setattr(M, "TASK_ROWS", 25)
    rows = [(i, *[float(i % (j + 2)) for j in range(len(FEATURE_COLUMNS))], int(i % 10 == 0)) for i in range(1000)]
    frame = spark.createDataFrame(rows, f"txn_id long, {', '.join(f'{c} double' for c in FEATURE_COLUMNS)}, label int").coalesce(1)
    train, _, _ = M.fit_prepare(frame, frame)
    sizes = train.rdd.glom().map(len).collect()
    assert sum(sizes) == 900 + 450 and len(sizes) >= 54 and max(sizes) <= 50
    few = spark.range(0, 100, 1, 16)
    assert M._spread(few, 100) is few


def test_a_forest_with_kept_nodes_has_the_same_trees(spark, monkeypatch):
    train = spark.createDataFrame([(i, *[float((i * (j + 3)) % 17) for j in range(len(FEATURE_COLUMNS))], i % 3 % 2, 1.0) for i in range(300)],
                                  f"txn_id long, {', '.join(f'{c} double' for c in FEATURE_COLUMNS)}, label int, weight double").repartition(2).cache()
    kept = M.fit_rf(train, trees=5, depth=6)
    monkeypatch.setattr(M, "NODE_IDS", 0)
    walked = M.fit_rf(train, trees=5, depth=6)
    assert kept.toDebugString == walked.toDebugString.replace(walked.uid, kept.uid)
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()


def test_the_svm_stores_no_waves(spark, monkeypatch):
    train = spark.createDataFrame([(i, *[float((i * (j + 3)) % 17) for j in range(len(FEATURE_COLUMNS))], i % 3 % 2, 1.0) for i in range(200)],
                                  f"txn_id long, {', '.join(f'{c} double' for c in FEATURE_COLUMNS)}, label int, weight double")
    stored = []
    monkeypatch.setattr(M, "cut_lineage", lambda df: stored.append(df) or df)
    svm = M.RffSvm(dims=16).fit(train)
    assert [df.columns for df in stored] == [["label", "weight", "features"]] and svm.predict(train).count() == 200
    assert stored[0].select(F.max(F.size(vector_to_array("features")))).first()[0] == 1
