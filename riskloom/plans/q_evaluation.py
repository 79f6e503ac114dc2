"""Evaluation queries over the scored adapter (fixture label and scores)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import evaluation as EV
from riskloom.operators import sampling as SA
from riskloom.operators.ranking import exact_quantile
from riskloom.plans import inputs
from riskloom.plans.catalog import register
from riskloom.plans.sql import base
from riskloom.session import cut_lineage

# models evaluated on the fixture: score column per model; the anomaly model has no AUC
MODELS = {"ml": "ml_probability", "rules": "rule_score", "hybrid": "fraud_probability", "anomaly": "anomaly_score"}
RANKED_MODELS = ["ml", "rules", "hybrid"]
CONTAMINATION = 0.013
SEED = 42

_LS = " UNION ALL ".join(f"SELECT isFraud AS label, '{m}' AS model, CAST({c} AS DOUBLE) AS score FROM scored"
                         for m, c in MODELS.items())
_CM = f""", ls AS ({_LS})
, cm AS (SELECT model, count(*) FILTER (WHERE label = 1 AND score > 0.5) AS TP,
                count(*) FILTER (WHERE label <> 1 AND score <= 0.5) AS TN,
                count(*) FILTER (WHERE label <> 1 AND score > 0.5) AS FP,
                count(*) FILTER (WHERE label = 1 AND score <= 0.5) AS FN FROM ls GROUP BY model)"""
_DIV = "CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"
_MET = f""", met AS (SELECT model, TP, TN, FP, FN,
  round({_DIV.format(a='CAST(TP + TN AS DOUBLE)', b='CAST(TP + TN + FP + FN AS DOUBLE)')}, 4) AS accuracy,
  round({_DIV.format(a='CAST(TP AS DOUBLE)', b='CAST(TP + FP AS DOUBLE)')}, 4) AS precision,
  round({_DIV.format(a='CAST(TP AS DOUBLE)', b='CAST(TP + FN AS DOUBLE)')}, 4) AS recall,
  round({_DIV.format(a='2 * CAST(TP AS DOUBLE)', b='2 * CAST(TP AS DOUBLE) + FP + FN')}, 4) AS f1_score FROM cm)"""
_AUC = """, d AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
         FROM ls WHERE model <> 'anomaly' GROUP BY model, score)
, c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS neg_below FROM d)
, auc AS (SELECT model, sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc FROM c GROUP BY model)"""


def _long(spark, sf_dir):
    return EV.long_scores(inputs.scored(spark, sf_dir), MODELS)


def _metrics(spark, sf_dir):
    ls = _long(spark, sf_dir).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return EV.metrics_from_confusion(EV.confusion(ls, by=["model"]))


@register("confusion_matrix", base(f"{_CM} SELECT * FROM cm"))
def confusion_matrix(spark, sf_dir):
    ls = _long(spark, sf_dir).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    return EV.confusion(ls, by=["model"])


@register("binary_metrics", base(f"{_CM}{_MET} SELECT model, accuracy, precision, recall, f1_score FROM met"))
def binary_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("model", "accuracy", "precision", "recall", "f1_score")


@register("roc_auc", base(f"{_CM}{_AUC} SELECT model, round(roc_auc, 6) AS roc_auc FROM auc"))
def roc_auc(spark, sf_dir):
    ls = _long(spark, sf_dir).filter(F.col("model").isin(RANKED_MODELS))
    return EV.roc_auc(ls, by=["model"]).select("model", F.round("roc_auc", 6).alias("roc_auc"))


@register("roc_points", base(f"""{_CM}
, b AS (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
        FROM ls WHERE model = 'hybrid' GROUP BY 1)
SELECT threshold,
  round(sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(neg) OVER (), 6) AS fpr,
  round(sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(pos) OVER (), 6) AS tpr
FROM b UNION ALL SELECT CAST('Infinity' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)"""))
def roc_points(spark, sf_dir):
    ls = _long(spark, sf_dir).filter(F.col("model") == "hybrid")
    p = EV.roc_points(ls.drop("model"))
    return p.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("model_comparison", base(f"""{_CM}{_MET}{_AUC}
, m AS (SELECT met.*, round(auc.roc_auc, 4) AS roc_auc FROM met JOIN auc USING (model))
SELECT model, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL
SELECT model, 'precision', precision FROM m UNION ALL SELECT model, 'recall', recall FROM m UNION ALL
SELECT model, 'f1_score', f1_score FROM m UNION ALL SELECT model, 'roc_auc', roc_auc FROM m"""))
def model_comparison(spark, sf_dir):
    met = _metrics(spark, sf_dir)
    ls = _long(spark, sf_dir).filter(F.col("model").isin(RANKED_MODELS))
    auc = EV.roc_auc(ls, by=["model"]).select("model", F.round("roc_auc", 4).alias("roc_auc"))
    # models without a ranking score (anomaly detectors) get a null AUC and are skipped
    return EV.model_comparison(met.join(auc, "model", "left"))


@register("class_balance", base("""SELECT isFraud AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM feat GROUP BY isFraud"""))
def class_balance(spark, sf_dir):
    cb = EV.class_balance(inputs.labels(spark, sf_dir))
    return cb.select("label", "n", F.round("share", 6).alias("share"))


@register("class_weights", base("""SELECT isFraud AS label, count(*) AS n_c,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM feat GROUP BY isFraud"""))
def class_weights(spark, sf_dir):
    cw = EV.class_weights(inputs.labels(spark, sf_dir))
    return cw.select("label", "n_c", F.round("weight", 6).alias("weight"))


_H = f"CAST('0x' || substr(md5('{SEED}:' || CAST(txn_id AS VARCHAR)), 1, 8) AS BIGINT)"
_RANK = f"row_number() OVER (PARTITION BY isFraud ORDER BY {_H}, txn_id) - 1"


@register("stratified_split", base(f"""SELECT txn_id, isFraud,
  CAST({_RANK} < round(count(*) OVER (PARTITION BY isFraud) * 0.2, 0) AS INTEGER) AS is_test FROM feat"""))
def stratified_split(spark, sf_dir):
    f = inputs.labels(spark, sf_dir)
    return SA.stratified_split(f, seed=SEED).select("txn_id", "isFraud", "is_test")


@register("stratified_folds", base(f"SELECT txn_id, isFraud, CAST(({_RANK}) % 5 AS INTEGER) AS fold FROM feat"))
def stratified_folds(spark, sf_dir):
    f = inputs.labels(spark, sf_dir)
    return SA.stratified_folds(f, seed=SEED).select("txn_id", "isFraud", "fold")


@register("cv_summary", base(f"""
, fo AS (SELECT isFraud AS label, CAST(fraud_probability > 0.5 AS INTEGER) AS pred, ({_RANK}) % 5 AS fold FROM scored)
, pf AS (SELECT fold, count(*) FILTER (WHERE label = 1 AND pred = 1) AS TP, count(*) FILTER (WHERE label <> 1 AND pred = 1) AS FP,
                count(*) FILTER (WHERE label = 1 AND pred <> 1) AS FN FROM fo GROUP BY fold)
, f1 AS (SELECT fold, round({_DIV.format(a='2 * CAST(TP AS DOUBLE)', b='2 * CAST(TP AS DOUBLE) + FP + FN')}, 4) AS f1_score FROM pf)
SELECT round(avg(f1_score), 4) AS mean, round(stddev_pop(f1_score) * 2, 4) AS std2 FROM f1"""))
def cv_summary(spark, sf_dir):
    s = inputs.scored(spark, sf_dir).select("txn_id", F.col("isFraud").alias("label"),
                                             (F.col("fraud_probability") > 0.5).cast("int").alias("pred"))
    folds = SA.stratified_folds(s, label="label", seed=SEED)
    per_fold = EV.metrics_from_confusion(EV.confusion(folds, by=["fold"]))
    cv = EV.cv_summary(per_fold)
    return cv.select(F.round("mean", 4).alias("mean"), F.round("std2", 4).alias("std2"))


@register("anomaly_threshold", base(f"""
, t AS (SELECT quantile_cont(anomaly_score, {1 - CONTAMINATION}) AS thr FROM scored)
SELECT round(thr, 6) AS threshold, (SELECT count(*) FROM scored WHERE anomaly_score > thr) AS flagged FROM t"""))
def anomaly_threshold(spark, sf_dir):
    # the one column is written once; the threshold takes several passes over it
    s = cut_lineage(inputs.scored(spark, sf_dir).select("anomaly_score"))
    thr = exact_quantile(s, "anomaly_score", 1 - CONTAMINATION)
    return s.agg(F.round(F.lit(thr), 6).alias("threshold"),
                 F.count_if(F.col("anomaly_score") > F.lit(thr)).alias("flagged"))
