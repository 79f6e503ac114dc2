"""Hybrid scoring with model objects: record, stream = batch, save -> load -> same rows."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.hybrid import HybridModels, predictions, score_with_models
from riskloom.operators.models import load_models, save_models
from riskloom.operators.validate import coerce_online, split_valid
from riskloom.plans import inputs
from riskloom.plans.q_scoring import fixed_models
from tests.conftest import SF_SMALL

COLS = ["txn_id", "ml_probability", "anomaly_decision", "fraud_probability", "fraud_label"]


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features"))
    inputs.features(spark, SF_SMALL).write.mode("overwrite").parquet(path)
    return path


def rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def test_stream_equals_batch(spark, features, scratch):
    batch = spark.read.parquet(features)
    want = rows(score_with_models(batch, fixed_models(spark)))
    stream = score_with_models(spark.readStream.schema(batch.schema).parquet(features), fixed_models(spark))
    query = (stream.select(*COLS).writeStream.format("parquet").option("path", f"{scratch}/out")
             .option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.read.parquet(f"{scratch}/out")) == want


def test_record_carries_top_importances(spark, features):
    models = fixed_models(spark)
    models.importances = [(f"f{i}", i / 100) for i in range(12)]
    for top in (8, 12):
        r = predictions(spark.read.parquet(features), models, top=top).first()["prediction"]
        assert len(r["feature_importance"]) == top and r["feature_importance"]["f11"] == 0.11


def test_saved_models_score_alike(spark, features, scratch):
    m = fixed_models(spark)
    path = f"file://{scratch}/models"
    save_models(path, lr=m.classifier, iforest=m.forest, scaler=m.scaler, spark=spark)
    got = load_models(spark, path)
    again = HybridModels({k: got["scaler"][k] for k in m.scaler}, got["lr"], got["iforest"])
    df = spark.read.parquet(features).limit(50).cache()
    assert rows(score_with_models(df, again)) == rows(score_with_models(df, m))
    with pytest.raises(FileNotFoundError):
        load_models(spark, f"file://{scratch}/nothing")


def test_online_payloads(spark):
    payloads = ['{"amount":"250000","login_attempts":"5","account_age":29.7}', '{"amount":null}', '{"type":"DEBIT"}', '{"amount":"NaN"}',
                '{"amount":"12.5d"}', '{"amount":1e400}', '{"amount":-3,"geo_distance":"Infinity","hour_of_day":-2.9}', "not json", None]
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, payload string")
    valid, bad = split_valid(coerce_online(df))
    got = {r["id"]: r for r in valid.collect()}
    assert set(got) == {0, 6}
    assert (got[0]["amount"], got[0]["login_attempts"], got[0]["account_age"]) == (250000.0, 5, 29)
    assert (got[6]["amount"], got[6]["geo_distance"], got[6]["hour_of_day"]) == (-3.0, None, -2)
    assert bad.where(F.col("quarantine_reason") == "missing amount").count() == 4
