"""Model training and scoring queries (rows-only checks: model outputs have no
SQL statement).  Training data: the adapter's feature table with the fixture
label; split, scaled and oversampled as in ``operators.models``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scalars import display_name
from riskloom.operators import evaluation as EV
from riskloom.operators import models as M
from riskloom.operators import sampling as SA
from riskloom.operators import training as TR
from riskloom.operators.anomaly import fit_iforest, score_iforest
from riskloom.operators.hybrid import HybridModels, predictions
from riskloom.operators.scaling import apply_scaler, fit_scaler
from riskloom.operators.scoring import anomaly_score
from riskloom.plans import inputs
from riskloom.plans.catalog import register
from riskloom.plans.sql import base
from riskloom.schemas import FEATURE_COLUMNS
from riskloom.session import cut_lineage, ensure_checkpoint_dir
from riskloom.sources.tables import cached, read_metrics

SEED = 42
# part of the run's key: to be raised when features, models or metrics change
RUN_VERSION = "1"


def _prepared(spark, sf_dir, oversample=True):
    frame = M.training_frame(inputs.features(spark, sf_dir))
    return M.prepare(frame, seed=SEED, oversample=oversample)


def _scores(pred):
    return pred.select("txn_id", "label", F.round("probability", 6).alias("probability"), "prediction")


@register("lr_scores")
def lr_scores(spark, sf_dir):
    train, test, _ = _prepared(spark, sf_dir)
    return _scores(M.predict(M.fit_lr(train), test))


@register("rf_scores")
def rf_scores(spark, sf_dir):
    train, test, _ = _prepared(spark, sf_dir)
    return _scores(M.predict(M.fit_rf(train), test))


@register("svm_scores")
def svm_scores(spark, sf_dir):
    train, test, _ = _prepared(spark, sf_dir)
    return _scores(M.RffSvm(seed=SEED).fit(train).predict(test))


@register("iforest_scores")
def iforest_scores(spark, sf_dir):
    train, test, _ = _prepared(spark, sf_dir, oversample=False)
    model = fit_iforest(train, FEATURE_COLUMNS, seed=SEED)
    s = score_iforest(spark, test, model)
    return s.select("txn_id", F.round("iforest_score", 6).alias("iforest_score"),
                    F.round("decision", 6).alias("decision"), "is_anomaly",
                    F.round(anomaly_score("decision"), 6).alias("anomaly_score"))


def _importance_df(spark, sf_dir):
    train, _, _ = _prepared(spark, sf_dir)
    ranked = M.importance(M.fit_rf(train))
    rows = [(i + 1, c, v) for i, (c, v) in enumerate(ranked)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


@register("feature_importance")
def feature_importance(spark, sf_dir):
    return _importance_df(spark, sf_dir)


@register("top_features")
def top_features(spark, sf_dir, n: int = 8):
    return _shown(_importance_df(spark, sf_dir), n)


def _shown(importance, n: int):
    top = importance.filter(F.col("rank") <= n)
    mx = top.agg(F.max("importance")).first()[0] or 1.0
    return top.select("rank", "feature", display_name("feature").alias("display_name"), "importance",
                      F.round(F.lit(0.4) + F.col("importance") / F.lit(mx) * 0.6, 4).alias("weight"))


@register("cv_models")
def cv_models(spark, sf_dir):
    """ML11: per-fold F1 of the forest inside the training part, scaling and oversampling inside each fold."""
    split = SA.stratified_split(cut_lineage(M.training_frame(inputs.features(spark, sf_dir))), label="label", key="txn_id", seed=SEED)
    return M.cross_validate(split.filter("is_test = 0").drop("is_test", "class_rank"), seed=SEED)


# ---------------------------------------------------------------- the prepared table, checked by SQL

_FRAME = f"SELECT txn_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATURE_COLUMNS)}, isFraud AS label FROM feat"
_SPLIT = f""", fr AS ({_FRAME})
, sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY CAST('0x' || substr(md5('{SEED}:' || CAST(txn_id AS VARCHAR)), 1, 8) AS BIGINT), txn_id) - 1
    < round(count(*) OVER (PARTITION BY label) * 0.2, 0) AS test FROM fr)
, st AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM sp WHERE NOT test" for c in FEATURE_COLUMNS)})"""


def _split(spark, sf_dir):
    frame = cut_lineage(M.training_frame(inputs.features(spark, sf_dir)))
    return cut_lineage(SA.stratified_split(frame, label="label", key="txn_id", seed=SEED))


@register("training_frame", base(f"SELECT txn_id, label, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURE_COLUMNS)} FROM ({_FRAME})"))
def training_frame(spark, sf_dir):
    """PRJ1: id, the ordered model features and the label."""
    f = M.training_frame(inputs.features(spark, sf_dir))
    return f.select("txn_id", "label", *[F.round(c, 6).alias(c) for c in FEATURE_COLUMNS])


@register("train_scaler", base(f"{_SPLIT} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM st"))
def train_scaler(spark, sf_dir):
    """ML3: means and population deviations of the training part alone."""
    st = EV.scaler_stats(_split(spark, sf_dir).filter("is_test = 0"), FEATURE_COLUMNS)
    return st.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("test_scaled", base(f"""{_SPLIT}
, lg AS ({' UNION ALL '.join(f"SELECT txn_id, '{c}' AS feature, {c} AS v FROM sp WHERE test" for c in FEATURE_COLUMNS)})
SELECT txn_id, feature, round(CASE WHEN std = 0 THEN 0.0 ELSE (v - mean) / std END, 6) AS value FROM lg JOIN st USING (feature)"""))
def test_scaled(spark, sf_dir):
    """ML3: the test part scaled with the training part's statistics."""
    split = _split(spark, sf_dir)
    scaled = apply_scaler(split.filter("is_test = 1"), fit_scaler(split.filter("is_test = 0"), FEATURE_COLUMNS))
    stack = ", ".join(f"'{c}', {c}" for c in FEATURE_COLUMNS)
    return scaled.selectExpr("txn_id", f"stack({len(FEATURE_COLUMNS)}, {stack}) AS (feature, v)").select("txn_id", "feature", F.round("v", 6).alias("value"))


# ---------------------------------------------------------------- one run of training and evaluation

def _run(spark, sf_dir) -> str:
    """The folder of the run for the present input tables: trained once for each state of them."""
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("events", "customer")]
    root = f"{ensure_checkpoint_dir(spark)}/training"
    return cached(spark, root, paths, RUN_VERSION, lambda out: TR.train_and_evaluate(inputs.features(spark, sf_dir), out))


@register("train_metrics")
def train_metrics(spark, sf_dir):
    """EV1-EV3 of the five models over the written predictions of the test part."""
    return TR.metrics_of(TR.predictions(spark, _run(spark, sf_dir)))


@register("train_curves")
def train_curves(spark, sf_dir):
    """EV4: the ROC points of the three classifiers."""
    c = TR.curves_of(TR.predictions(spark, _run(spark, sf_dir)))
    return c.select("model", F.round("threshold", 6).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("train_document")
def train_document(spark, sf_dir):
    """SNK3 + SRC5: the metrics document of the run, written and read again, as (model, metric, value)."""
    d = read_metrics(spark, f"{_run(spark, sf_dir)}/document").select(F.explode("models").alias("model", "m"))
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    return d.select("model", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"m.{n}"))])).alias("metric", "value")).filter("value IS NOT NULL")


@register("top12_features")
def top12_features(spark, sf_dir):
    """ORD6 + SC18 + SC24: the twelve most important features of the fitted forest, as shown."""
    return _shown(spark.read.parquet(f"{_run(spark, sf_dir)}/importance"), 12)


@register("hybrid_trained")
def hybrid_trained(spark, sf_dir):
    """ML13, ML14, ORD5: every transaction scored by the loaded models of the run, with the eight most important features."""
    path = _run(spark, sf_dir)
    m = M.load_models(spark, f"{path}/models")
    top = [(r["feature"], r["importance"]) for r in spark.read.parquet(f"{path}/importance").orderBy("rank").collect()]
    models = HybridModels(m["scaler"], m["rf"], m["iforest"], top)
    return predictions(inputs.features(spark, sf_dir), models, top=8)
