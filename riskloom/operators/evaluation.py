"""Evaluation operators (EV1-EV5, AG3-AG8) as aggregates.

Several models are evaluated in one pass by stacking (model, score) pairs and
grouping by model.  Exact ROC-AUC uses the Mann-Whitney form over distinct
scores with range-partitioned prefix counts (no single-task global sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import ranges_for, with_range


def long_scores(df: DataFrame, models: dict[str, str], label: str = "isFraud") -> DataFrame:
    """(model, label, score) rows for each model's score column (one pass)."""
    parts = ", ".join(f"'{m}', CAST(`{c}` AS DOUBLE)" for m, c in models.items())
    return df.selectExpr(f"CAST(`{label}` AS INT) AS label", f"stack({len(models)}, {parts}) AS (model, score)")


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """EV1: TP, TN, FP, FN (bigint) per group."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    aggs = [F.count_if(y & p).alias("TP"), F.count_if(~y & ~p).alias("TN"),
            F.count_if(~y & p).alias("FP"), F.count_if(y & ~p).alias("FN")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def metrics_from_confusion(cm: DataFrame, digits: int = 4) -> DataFrame:
    """EV2: accuracy, precision, recall, F1 with zero division -> 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("TP", "TN", "FP", "FN"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    f1 = _safe_div(2 * tp, 2 * tp + fp + fn)
    return cm.withColumns({
        "accuracy": F.round(_safe_div(tp + tn, tp + tn + fp + fn), digits),
        "precision": F.round(prec, digits),
        "recall": F.round(rec, digits),
        "f1_score": F.round(f1, digits),
    })


def rankable(scores: DataFrame) -> DataFrame:
    """Rows with a label and a score that has a place in the order (not null, not NaN)."""
    return scores.where(F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))


def _below(scores: DataFrame, by: list[str], ranges: int | None) -> DataFrame:
    """Per group and distinct score: pos and neg at it, ``pos_below`` and ``neg_below``.

    Distinct scores are grouped first (skew-safe), then split into score ranges
    by approximate quantiles; each range computes its local prefix and adds the
    totals of all lower ranges from a small table."""
    from riskloom.session import cut_lineage

    d = cut_lineage(rankable(scores).groupBy(*by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"),
                                                     F.count_if(F.col("label") != 1).alias("neg")))
    if ranges is None:  # about ROWS_PER_RANGE distinct scores per range task
        ranges = min(ranges_for(d.count(), minimum=64), 1 << 16)
    probs = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(b for b in d.approxQuantile("score", probs, 0.5 / ranges) if b is not None)) if ranges > 1 else []
    d = with_range(d, "score", bounds)
    tot = d.groupBy(*by, "_r").agg(F.sum("neg").alias("_rn"), F.sum("pos").alias("_rp"))
    wr = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    tot = tot.select(*by, "_r", F.coalesce(F.sum("_rn").over(wr), zero).alias("_n0"), F.coalesce(F.sum("_rp").over(wr), zero).alias("_p0"))
    wl = Window.partitionBy(*by, "_r").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_n1": F.coalesce(F.sum("neg").over(wl), zero), "_p1": F.coalesce(F.sum("pos").over(wl), zero)})
    return d.join(tot, [*by, "_r"]).select(*by, "score", "pos", "neg", (F.col("_n0") + F.col("_n1")).alias("neg_below"),
                                           (F.col("_p0") + F.col("_p1")).alias("pos_below"))


def roc_auc(scores: DataFrame, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """EV3: exact ROC-AUC per group (ties count one half), from (label, score).
    Rows without a label or with a null or NaN score take no part.

    AUC = sum over distinct s of pos(s) * (neg(<s) + neg(s)/2) / (P*N)."""
    by = by or []
    d = _below(scores, by, ranges)
    contrib = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    agg = d.groupBy(*by).agg(F.sum(contrib).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*by, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def roc_points(scores: DataFrame, by: list[str] | None = None, digits: int | None = None, ranges: int | None = None) -> DataFrame:
    """EV4: (threshold, fpr, tpr) for every distinct score, and the origin (0, 0)
    at an infinite threshold.  ``digits`` bins the scores first, if asked for."""
    by = by or []
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    d = _below(scores, by, ranges)
    total = d.groupBy(*by).agg(F.sum("neg").alias("_n"), F.sum("pos").alias("_p"))
    one = [*by, "_one"]
    pts = d.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), one)
    pts = pts.select(*by, F.col("score").cast("double").alias("threshold"),
                     F.try_divide(F.col("_n") - F.col("neg_below"), F.col("_n")).alias("fpr"),
                     F.try_divide(F.col("_p") - F.col("pos_below"), F.col("_p")).alias("tpr"))
    return pts.union(total.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def class_balance(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """AG3-AG5: count and share per class (share of class 1 = fraud rate)."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """ML5: balanced weights n / (k * n_c) per class."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    allw = Window.partitionBy()
    return c.withColumn("weight", F.sum("n_c").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("n_c")))


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG6: mean and population std per feature, long form (feature, mean, std)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean, std)")


def cv_summary(per_fold: DataFrame, metric: str = "f1_score") -> DataFrame:
    """AG7: mean and 2 x population std of a per-fold metric."""
    return per_fold.agg(F.avg(metric).alias("mean"), (F.stddev_pop(metric) * 2).alias("std2"))


def model_comparison(metrics: DataFrame) -> DataFrame:
    """EV5: long form (model, metric, value), skipping models without AUC."""
    m = metrics.filter(F.col("roc_auc").isNotNull())
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    stack = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return m.selectExpr("model", f"stack({len(names)}, {stack}) AS (metric, value)")
