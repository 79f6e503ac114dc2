"""Supervised training on the feature table (ML1, ML3-ML8, ML11-ML13).

Order of stages is a leakage invariant: split -> fit scaler on train ->
oversample train only -> class weights on the oversampled train -> fit;
the test rows are only ever transformed.  The prepared training set is
checkpointed once (reliable checkpoint) because several models reuse it.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import sampling as SA
from riskloom.operators.neighbors import LofIndex, knn
from riskloom.operators.scaling import apply_scaler, fit_scaler
from riskloom.operators.validate import clean_nonfinite
from riskloom.schemas import FEATURE_COLUMNS
from riskloom.session import cut_lineage

TASK_ROWS = 200_000  # training rows of a task
SMALL_ROWS = 20_000  # training rows that are left in the tasks where they are
NODE_IDS = 400_000_000  # rows times trees up to which a forest keeps the node of each row (4 bytes each)


def training_frame(features: DataFrame, label: str = "isFraud", id_col: str = "txn_id") -> DataFrame:
    """PRJ1 + FLT3: id, the ordered model features (as double) and the label."""
    df = features.select(id_col, *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS],
                         F.col(label).cast("int").alias("label"))
    return clean_nonfinite(df, FEATURE_COLUMNS)


def prepare(frame: DataFrame, *, test_fraction: float = 0.2, ratio: float = 0.5, k: int = 5, seed: int = 42,
            id_col: str = "txn_id", oversample: bool = True):
    """Returns (train, test, scaler stats).  ``train`` carries a ``weight`` column
    (balanced weights n / (2 n_c) after oversampling)."""
    # the feature frame is read by several passes (class sizes, ranks, split): materialise it once
    frame = cut_lineage(frame)
    split = cut_lineage(SA.stratified_split(frame, label="label", key=id_col, test_fraction=test_fraction, seed=seed))
    train = split.filter(F.col("is_test") == 0).drop("is_test", "class_rank")
    test = split.filter(F.col("is_test") == 1).drop("is_test", "class_rank")
    return fit_prepare(train, test, ratio=ratio, k=k, seed=seed, id_col=id_col, oversample=oversample)


def fit_prepare(train: DataFrame, test: DataFrame, *, ratio: float = 0.5, k: int = 5, seed: int = 42,
                id_col: str = "txn_id", oversample: bool = True):
    """Scaler fitted on ``train`` only, oversampling of ``train`` only, balanced
    weights; ``test`` is only transformed."""
    stats = fit_scaler(train, FEATURE_COLUMNS)
    train, test = apply_scaler(train, stats), apply_scaler(test, stats)
    if oversample:
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        n_min, n_maj = counts.get(1, 0), counts.get(0, 0)
        needed = SA.oversample_plan(n_min, n_maj, ratio)
        if needed > 0 and n_min > 1:
            mino = train.filter(F.col("label") == 1).select(id_col, F.array(*FEATURE_COLUMNS).alias("features"))
            mino = cut_lineage(mino)
            nn = knn(mino, mino, min(k, n_min - 1), id_col=id_col)
            syn = SA.smote(mino, nn, needed, n_min, id_col=id_col, k=min(k, n_min - 1), seed=seed)
            syn = syn.select((-(F.col("syn_id") + 1)).alias(id_col),
                             *[F.element_at("features", i + 1).alias(c) for i, c in enumerate(FEATURE_COLUMNS)],
                             F.lit(1).alias("label"))
            train = train.unionByName(syn)
    sizes = {r["label"]: r["_nc"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("_nc")).collect()}
    total, ncls = sum(sizes.values()), len(sizes)
    # class weights from the (bounded) class sizes: n / (classes * n_c)
    cw = train.sparkSession.createDataFrame([(int(k), float(total) / (ncls * v)) for k, v in sizes.items()],
                                            "label int, weight double")
    train = cut_lineage(_spread(train.join(F.broadcast(cw), "label"), total))
    return train, test, stats


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of equal size, of at most about TASK_ROWS of its ``rows``: the fits go over them again and
    again, and the synthetic rows, a third of them, would be in the one or two tasks that made them."""
    if rows <= SMALL_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def _assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features").transform(df)


def fit_lr(train: DataFrame, max_iter: int = 1000, C: float = 1.0, tol: float = 1e-4):
    """ML6: L2 logistic regression with balanced weights.  Spark averages the
    weighted loss, so C maps to regParam = 1 / (C * sum of weights); ``tol`` is
    the usual lbfgs stopping tolerance (1e-4), ``max_iter`` only a cap."""
    wsum = train.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter,
                            regParam=1.0 / (C * wsum), elasticNetParam=0.0, standardization=False, tol=tol)
    return lr.fit(_assemble(train))


def fit_rf(train: DataFrame, trees: int = 200, depth: int = 15, min_leaf: int = 4, seed: int = 42):
    """ML7: random forest (sqrt features per split; Spark has no min-split knob)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees,
                                maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt",
                                seed=seed)
    # the same trees; kept node numbers spare the walks from the roots, but there is one for each row and tree
    rf.setCacheNodeIds(train.count() * trees <= NODE_IDS).setCheckpointInterval(-1)
    return rf.fit(_assemble(train))


def predict(model, df: DataFrame, id_col: str = "txn_id") -> DataFrame:
    """ML13: (id, label, probability of class 1, prediction)."""
    out = model.transform(_assemble(df))
    return out.select(id_col, "label", vector_to_array("probability")[1].alias("probability"),
                      F.col("prediction").cast("int").alias("prediction"))


def importance(model, digits: int = 4) -> list[tuple[str, float]]:
    """ML12/ORD4: (feature, importance) sorted descending, ties in feature order."""
    vals = model.featureImportances.toArray().tolist()
    pairs = [(c, round(float(v), digits), i) for i, (c, v) in enumerate(zip(FEATURE_COLUMNS, vals))]
    return [(c, v) for c, v, _ in sorted(pairs, key=lambda t: (-t[1], t[2]))]


# ---------------------------------------------------------------- RBF SVM via random features

class RffSvm:
    """ML8 re-aimed: an RBF-kernel SVM approximated by random Fourier features
    (Rahimi & Recht 2007) + LinearSVC, with Platt scaling by a one-feature
    logistic regression on the margin.  The projection (D x d, bounded by its
    parameters) travels with an Arrow function, one matrix product a batch; the
    rest is Spark ML."""

    def __init__(self, dims: int = 256, gamma: float | None = None, max_iter: int = 2000, seed: int = 42):
        self.dims, self.gamma, self.max_iter, self.seed = dims, gamma, max_iter, seed

    def _project(self, df: DataFrame) -> DataFrame:
        w, b, scale = np.array(self.w).T, np.array(self.b), math.sqrt(2.0 / self.dims)

        @F.pandas_udf("array<double>")
        def waves(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            return pd.Series(list(scale * np.cos(x @ w + b)))

        return df.withColumn("features", array_to_vector(waves(*FEATURE_COLUMNS)))

    def fit(self, train: DataFrame):
        d = len(FEATURE_COLUMNS)
        gamma = self.gamma or 1.0 / d  # 'scale' on standardised features
        rng = random.Random(self.seed)
        self.w = [[rng.gauss(0.0, math.sqrt(2.0 * gamma)) for _ in range(d)] for _ in range(self.dims)]
        self.b = [rng.uniform(0.0, 2.0 * math.pi) for _ in range(self.dims)]
        # projected anew in each pass: stored, the waves are some fifteen times the training rows
        z = self._project(train)
        self.svc = LinearSVC(featuresCol="features", labelCol="label", weightCol="weight", tol=1e-3,
                             maxIter=self.max_iter, regParam=1.0 / train.agg(F.sum("weight")).first()[0]).fit(z)
        margin = self.svc.transform(z).select("label", "weight",
                                              array_to_vector(F.array(vector_to_array("rawPrediction")[1]))
                                              .alias("features"))
        margin = cut_lineage(margin)  # one number a row
        self.platt = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                        predictionCol="_platt_pred", rawPredictionCol="_platt_raw").fit(margin)
        return self

    def predict(self, df: DataFrame, id_col: str = "txn_id") -> DataFrame:
        z = self.svc.transform(self._project(df))
        m = z.select(id_col, "label", F.col("prediction").cast("int").alias("prediction"),
                     array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"))
        p = self.platt.transform(m)
        return p.select(id_col, "label", vector_to_array("probability")[1].alias("probability"), "prediction")

    def save(self, path: str) -> None:
        """SNK4: the two Spark ML models, and the projection as a table of waves."""
        self.svc.write().overwrite().save(f"{path}/svc")
        self.platt.write().overwrite().save(f"{path}/platt")
        rows = [(i, w, b) for i, (w, b) in enumerate(zip(self.w, self.b))]
        SparkSession.active().createDataFrame(rows, "wave int, w array<double>, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/waves")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RffSvm:
        from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel

        waves = spark.read.parquet(f"{path}/waves").orderBy("wave").collect()  # ``dims`` rows
        out = cls(dims=len(waves))
        out.w, out.b = [list(r["w"]) for r in waves], [r["b"] for r in waves]
        out.svc, out.platt = LinearSVCModel.load(f"{path}/svc"), LogisticRegressionModel.load(f"{path}/platt")
        return out


def cross_validate(train_rows: DataFrame, *, folds: int = 5, seed: int = 42, trees: int = 100, depth: int = 15,
                   id_col: str = "txn_id", parallelism: int = 2) -> DataFrame:
    """ML11: stratified k-fold F1 of the random forest inside the training rows (give
    it no test rows), with scaling and oversampling fitted inside each fold.  Every
    fold is a distributed fit on one prepared table; ``parallelism`` of them run at a time."""
    spark = train_rows.sparkSession
    f = cut_lineage(SA.stratified_folds(train_rows, label="label", key=id_col, k=folds, seed=seed))

    def fold_f1(i: int) -> tuple[int, float]:
        tr = f.filter(F.col("fold") != i).drop("fold", "class_rank")
        va = f.filter(F.col("fold") == i).drop("fold", "class_rank")
        train, val, _ = fit_prepare(tr, va, seed=seed, id_col=id_col)
        pred = predict(fit_rf(train, trees=trees, depth=depth, min_leaf=1, seed=seed), val, id_col)
        c = pred.agg(F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp"),
                     F.count_if((F.col("label") != 1) & (F.col("prediction") == 1)).alias("fp"),
                     F.count_if((F.col("label") == 1) & (F.col("prediction") != 1)).alias("fn")).first()
        den = 2 * c["tp"] + c["fp"] + c["fn"]
        return i, round(2 * c["tp"] / den, 4) if den else 0.0

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(fold_f1), range(folds)))
    return spark.createDataFrame(rows, "fold int, f1_score double")


# ---------------------------------------------------------------- persistence (SNK3, SNK4, SRC5, SRC6)

def metrics_document(spark, models: dict[str, dict], importance_pairs: list[tuple[str, float]], *,
                     primary: str, training_samples: int, test_samples: int, fraud_ratio: float) -> DataFrame:
    """D8: the metrics document as one row with the declared schema."""
    from riskloom.schemas import METRICS_DOCUMENT

    row = {
        "models": {name: {**{k: m.get(k) for k in ("accuracy", "precision", "recall", "f1_score", "roc_auc", "type")},
                          "confusion_matrix": m.get("confusion_matrix")} for name, m in models.items()},
        "feature_importance": dict(importance_pairs),
        "primary_model": primary,
        "feature_columns": list(FEATURE_COLUMNS),
        "training_samples": int(training_samples),
        "test_samples": int(test_samples),
        "fraud_ratio": float(fraud_ratio),
    }
    return spark.createDataFrame([row], METRICS_DOCUMENT)


def write_metrics(doc: DataFrame, path: str) -> None:
    doc.coalesce(1).write.mode("overwrite").json(path)


def save_models(path: str, *, lr=None, rf=None, svm=None, iforest=None, lof=None, scaler: dict | None = None, spark=None) -> None:
    """SNK4: Spark ML writers for the classifiers; the isolation forest as a
    Parquet node table plus its parameters; the outlier factor's index and the
    scaler statistics as Parquet."""
    if svm is not None:
        svm.save(f"{path}/svm")
    if lof is not None:
        lof.save(f"{path}/lof")
    if lr is not None:
        lr.write().overwrite().save(f"{path}/logistic_regression")
    if rf is not None:
        rf.write().overwrite().save(f"{path}/random_forest")
    if iforest is not None:
        spark.createDataFrame(iforest.nodes).write.mode("overwrite").parquet(f"{path}/isolation_forest/nodes")
        spark.createDataFrame([(iforest.psi, iforest.threshold, list(iforest.features))],
                              "psi int, threshold double, features array<string>") \
            .write.mode("overwrite").parquet(f"{path}/isolation_forest/params")
    if scaler is not None:
        spark.createDataFrame([(k, float(m), float(s or 0.0)) for k, (m, s) in scaler.items()],
                              "feature string, mean double, std double").write.mode("overwrite").parquet(f"{path}/scaler")


def load_models(spark, path: str) -> dict:
    """SRC6: load whatever ``save_models`` wrote, from any file system Spark knows;
    a folder without a model is an error."""
    from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel

    from riskloom.operators.anomaly import IsolationForestModel

    def there(name: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    out: dict = {}
    if there("logistic_regression"):
        out["lr"] = LogisticRegressionModel.load(f"{path}/logistic_regression")
    if there("random_forest"):
        out["rf"] = RandomForestClassificationModel.load(f"{path}/random_forest")
    if there("isolation_forest"):
        p = spark.read.parquet(f"{path}/isolation_forest/params").first()
        nodes = spark.read.parquet(f"{path}/isolation_forest/nodes").toPandas()
        out["iforest"] = IsolationForestModel(nodes, list(p["features"]), p["psi"], p["threshold"])
    if there("svm"):
        out["svm"] = RffSvm.load(spark, f"{path}/svm")
    if there("lof"):
        out["lof"] = LofIndex.load(spark, f"{path}/lof")
    if there("scaler"):
        out["scaler"] = {r["feature"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/scaler").collect()}
    if not out:
        raise FileNotFoundError(f"no saved model under {path}")
    return out
