"""One run of training and evaluation: its tables against SQL, its models saved and loaded."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as M
from riskloom.operators import training as TR
from riskloom.operators.validate import dedup_counted, removed_rows
from riskloom.plans import inputs
from riskloom.schemas import FEATURE_COLUMNS
from riskloom.sources.tables import read_metrics
from tests.conftest import SF_SMALL

SMALL = TR.Settings(trees=15, depth=6, folds=2, cv_trees=5, svm_dims=32, forest_trees=20, lof_neighbours=5)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    f = inputs.features(spark, SF_SMALL)
    again = f.limit(7).withColumn("txn_id", F.col("txn_id") + 10_000_000)  # the same rows under new ids
    TR.train_and_evaluate(f.unionByName(again), path, SMALL)
    return path


def test_dedup_is_counted(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, "a", None)], "id int, x string, y int")
    out = dedup_counted(df, ["x", "y"], "id")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", None, 3), (3, "b", 1, 1)]
    assert tuple(removed_rows(out).first()) == (4, 2) and tuple(removed_rows(out.limit(0)).first()) == (0, 0)


def test_metrics_equal_sql_over_the_written_predictions(spark, run):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW p AS SELECT * FROM read_parquet('{run}/predictions/*/*.parquet', hive_partitioning = true)")
    want = con.execute("""WITH c AS (SELECT model, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn,
        count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM p GROUP BY model)
      , a AS (SELECT x.model, avg(CASE WHEN x.probability > y.probability THEN 1.0 WHEN x.probability = y.probability THEN 0.5 ELSE 0.0 END) AS auc
              FROM p x JOIN p y ON x.model = y.model AND x.label = 1 AND y.label = 0 WHERE x.probability IS NOT NULL GROUP BY x.model)
      SELECT model, tp, tn, fp, fn, (tp + tn) / (tp + tn + fp + fn), coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0),
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), auc FROM c LEFT JOIN a USING (model) ORDER BY model""").fetchall()
    got = [tuple(r) for r in spark.read.parquet(f"{run}/metrics").orderBy("model").collect()]
    assert [g[0] for g in got] == sorted([TR.LR, TR.RF, TR.SVM, TR.IFOREST, TR.LOF])
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:9] == pytest.approx(w[5:9], abs=5.1e-5)
        assert (g[9] is None) == (w[9] is None) and (g[9] is None or g[9] == pytest.approx(w[9], abs=5.1e-5))
    assert {g[0] for g in got if g[9] is None} == set(TR.DETECTORS)
    # the points of a curve under which the area is the AUC
    for name, auc in ((g[0], g[9]) for g in got if g[9] is not None):
        pts = sorted((r["fpr"], r["tpr"]) for r in TR.curves_of(TR.predictions(spark, run)).filter(F.col("model") == name).collect())
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
        assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0) and area == pytest.approx(auc, abs=1e-4)


def test_the_test_part_is_untouched_and_repeats_are_counted(spark, run):
    p = TR.predictions(spark, run)
    n = {r["model"]: r["count"] for r in p.groupBy("model").count().collect()}
    assert len(set(n.values())) == 1 and p.filter("txn_id < 0 OR txn_id >= 10000000").count() == 0
    total = inputs.features(spark, SF_SMALL).select(*FEATURE_COLUMNS, "isFraud").distinct().count()
    assert abs(next(iter(n.values())) - 0.2 * total) <= 1
    rep = spark.read.parquet(f"{run}/repeats").first()
    assert rep["rows"] - rep["removed"] == total and rep["removed"] >= 7
    assert sorted(r["fold"] for r in spark.read.parquet(f"{run}/folds").collect()) == [0, 1]


def test_document_and_models(spark, run):
    doc = read_metrics(spark, f"{run}/document").first()
    metrics = {r["model"]: r for r in spark.read.parquet(f"{run}/metrics").collect()}
    assert doc["primary_model"] == TR.RF and doc["feature_columns"] == FEATURE_COLUMNS
    assert doc["models"][TR.RF]["confusion_matrix"]["TP"] == metrics[TR.RF]["TP"] and doc["models"][TR.LOF]["type"] == "anomaly_detection"
    ranked = spark.read.parquet(f"{run}/importance").orderBy("rank").collect()
    assert [r["importance"] for r in ranked] == sorted((r["importance"] for r in ranked), reverse=True) and len(ranked) == len(FEATURE_COLUMNS)
    # loaded models give the written predictions again
    m = M.load_models(spark, f"{run}/models")
    assert set(m) == {"lr", "rf", "svm", "iforest", "lof", "scaler"}
    wanted = {r["txn_id"]: r for r in TR.predictions(spark, run).filter(F.col("model") == TR.SVM).collect()}
    test = M.training_frame(inputs.features(spark, SF_SMALL)).filter(F.col("txn_id").isin(list(wanted)))
    from riskloom.operators.scaling import apply_scaler

    scaled = apply_scaler(test, m["scaler"])
    again = m["svm"].predict(scaled).collect()
    assert len(again) == len(wanted)
    for r in again:
        assert r["probability"] == pytest.approx(wanted[r["txn_id"]]["probability"], abs=1e-9)
    lof = {r["txn_id"]: r["is_outlier"] for r in m["lof"].score(TR._vectors(scaled)).collect()}
    assert lof == {r["txn_id"]: r["prediction"] for r in TR.predictions(spark, run).filter(F.col("model") == TR.LOF).collect()}
    assert json.dumps(doc.asDict(recursive=True))
