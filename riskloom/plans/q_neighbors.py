"""Neighbour, oversampling and scaling queries over ``embeddings``.

The binary task on embeddings: label 0 is the minority class, every other
label the majority.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riskloom.operators import neighbors as NB
from riskloom.operators import sampling as SA
from riskloom.operators.ranking import exact_quantile
from riskloom.operators.scaling import scale_long, scaler_stats_long
from riskloom.plans import inputs
from riskloom.plans.catalog import register
from riskloom.session import cut_lineage, ensure_checkpoint_dir

MINORITY_LABEL = 0
K_SMOTE, K_LOF = 5, 20
RATIO, SEED, CONTAMINATION = 0.5, 42, 0.013


def _dist(a: str, b: str) -> str:
    ai, bi = f"CAST({a}.embedding[i] AS DOUBLE)", f"CAST({b}.embedding[i] AS DOUBLE)"
    return (f"sqrt(list_sum(list_transform(range(1, len({a}.embedding) + 1), "
            f"lambda i: ({ai} - {bi}) * ({ai} - {bi}))))")


_KNN_MIN = f"""WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE label = {MINORITY_LABEL})
, pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id, {_dist('a', 'b')} AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id)
, knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour_id) AS INTEGER) AS nn_rank FROM pairs)
"""


def _minority(spark, sf_dir):
    return inputs.embeddings(spark, sf_dir).filter(F.col("label") == MINORITY_LABEL).select(
        "vec_id", NB.as_double_vector("embedding").alias("features"))


@register("knn_exact", _KNN_MIN + f"SELECT vec_id, neighbour_id, round(dist, 6) AS dist, nn_rank FROM knn WHERE nn_rank <= {K_SMOTE}")
def knn_exact(spark, sf_dir):
    m = _minority(spark, sf_dir)
    nn = NB.knn(m, m, K_SMOTE)
    return nn.select("vec_id", "neighbour_id", F.round("dist", 6).alias("dist"), "nn_rank")


_LOF_SQL = f"""WITH pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id, {_dist('a', 'b')} AS dist
                FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour_id) AS r FROM pairs)
         WHERE r <= {K_LOF})
, kd AS (SELECT vec_id, max(dist) AS kd FROM nn GROUP BY vec_id)
, lrd AS (SELECT nn.vec_id, 1.0 / (avg(greatest(kd.kd, nn.dist)) + {NB.LRD_EPS}) AS lrd
          FROM nn JOIN kd ON nn.neighbour_id = kd.vec_id GROUP BY nn.vec_id)
, lof AS (SELECT nn.vec_id, avg(l2.lrd) / any_value(l1.lrd) AS lof FROM nn JOIN lrd l2 ON nn.neighbour_id = l2.vec_id
          JOIN lrd l1 ON nn.vec_id = l1.vec_id GROUP BY nn.vec_id)
, thr AS (SELECT quantile_cont(lof, {1 - CONTAMINATION}) AS t FROM lof)
SELECT vec_id, round(lof, 6) AS lof, CAST(lof > t AS INTEGER) AS is_outlier FROM lof, thr"""


@register("lof_scores", _LOF_SQL)
def lof_scores(spark, sf_dir):
    e = inputs.embeddings(spark, sf_dir).select("vec_id", NB.as_double_vector("embedding").alias("features"))
    s = cut_lineage(NB.lof(e, K_LOF))
    thr = exact_quantile(s, "lof", 1 - CONTAMINATION)
    return s.select("vec_id", F.round("lof", 6).alias("lof"), (F.col("lof") > F.lit(thr)).cast("int").alias("is_outlier"))


K_SEARCH = 10


@register("knn_query", f"""WITH pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id, {_dist('a', 'b')} AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0)
SELECT vec_id, neighbour_id, round(dist, 6) AS dist, nn_rank FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour_id) AS INTEGER) AS nn_rank FROM pairs)
WHERE nn_rank <= {K_SEARCH}""")
def knn_query(spark, sf_dir):
    """J2 with two inputs: the search queries (ids divisible by 50) against all rows, themselves included."""
    e = inputs.embeddings(spark, sf_dir).select("vec_id", NB.as_double_vector("embedding").alias("features"))
    nn = NB.knn(e.filter(F.col("vec_id") % 50 == 0), e, K_SEARCH, exclude_self=False)
    return nn.select("vec_id", "neighbour_id", F.round("dist", 6).alias("dist"), "nn_rank")


def _h(seed, expr):
    return f"CAST('0x' || substr(md5('{seed}:' || {expr}), 1, 8) AS BIGINT)"


# fitted on the training part of a split by class, asked about the test part
_NOVELTY_SQL = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_h(SEED, 'CAST(vec_id AS VARCHAR)')}, vec_id) - 1
    < round(count(*) OVER (PARTITION BY y) * 0.2, 0) AS test
  FROM (SELECT vec_id, embedding, CAST(label = {MINORITY_LABEL} AS INTEGER) AS y FROM embeddings))
, pairs AS (SELECT a.vec_id, a.test, b.vec_id AS neighbour_id, {_dist('a', 'b')} AS dist
            FROM e a JOIN e b ON a.vec_id <> b.vec_id AND NOT b.test)
, nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour_id) AS r FROM pairs)
         WHERE r <= {K_LOF})
, kd AS (SELECT vec_id, max(dist) AS kd FROM nn WHERE NOT test GROUP BY vec_id)
, lrd AS (SELECT nn.vec_id, 1.0 / (avg(greatest(kd.kd, nn.dist)) + {NB.LRD_EPS}) AS lrd
          FROM nn JOIN kd ON nn.neighbour_id = kd.vec_id GROUP BY nn.vec_id)
, lof AS (SELECT nn.vec_id, nn.test, avg(l2.lrd) / any_value(l1.lrd) AS lof FROM nn JOIN lrd l2 ON nn.neighbour_id = l2.vec_id
          JOIN lrd l1 ON nn.vec_id = l1.vec_id GROUP BY nn.vec_id, nn.test)
, thr AS (SELECT quantile_cont(lof, {1 - CONTAMINATION}) AS t FROM lof WHERE NOT test)
SELECT vec_id, round(lof, 6) AS lof, CAST(lof > t AS INTEGER) AS is_outlier FROM lof, thr WHERE test"""


@register("lof_novelty", _NOVELTY_SQL)
def lof_novelty(spark, sf_dir):
    """ML10, novelty: an index of the training rows, saved and read again, scores the test rows."""
    e = inputs.embeddings(spark, sf_dir).select("vec_id", NB.as_double_vector("embedding").alias("features"),
                                                (F.col("label") == MINORITY_LABEL).cast("int").alias("y"))
    split = cut_lineage(SA.stratified_split(e, label="y", key="vec_id", seed=SEED))
    path = f"{ensure_checkpoint_dir(spark)}/lof-{uuid.uuid4().hex}"
    NB.LofIndex.fit(split.filter("is_test = 0"), K_LOF, contamination=CONTAMINATION).save(path)
    s = NB.LofIndex.load(spark, path).score(split.filter("is_test = 1"))
    return s.select("vec_id", F.round("lof", 6).alias("lof"), "is_outlier")


def _counts(spark, sf_dir):
    e = inputs.embeddings(spark, sf_dir)
    row = e.agg(F.count_if(F.col("label") == MINORITY_LABEL).alias("mn"),
                F.count_if(F.col("label") != MINORITY_LABEL).alias("mj")).first()
    return int(row["mn"]), int(row["mj"])


def _smote(spark, sf_dir):
    n_min, n_maj = _counts(spark, sf_dir)
    needed = SA.oversample_plan(n_min, n_maj, RATIO)
    m = _minority(spark, sf_dir)
    nn = NB.knn(m, m, K_SMOTE)
    return SA.smote(m, nn, needed, n_min, k=K_SMOTE, seed=SEED)


_SMOTE_SQL = _KNN_MIN + f"""
, cnt AS (SELECT count(*) FILTER (WHERE label = {MINORITY_LABEL}) AS mn, count(*) FILTER (WHERE label <> {MINORITY_LABEL}) AS mj
          FROM embeddings)
, need AS (SELECT mn, greatest(CAST(floor({RATIO} * mj) AS BIGINT) - mn, 0) AS needed FROM cnt)
, rk AS (SELECT v.vec_id, v.embedding, row_number() OVER (ORDER BY {_h(SEED, 'CAST(v.vec_id AS VARCHAR)')}, v.vec_id) - 1 AS rank0
         FROM v)
, cp AS (SELECT rk.*, need.mn, unnest(range(CAST(need.needed // need.mn + CASE WHEN rank0 < need.needed % need.mn THEN 1 ELSE 0 END AS BIGINT))) AS cpy
         FROM rk, need)
, sy AS (SELECT vec_id, embedding, cpy * mn + rank0 AS syn_id,
                CAST({_h(SEED + 1, "CAST(vec_id AS VARCHAR) || ':' || CAST(cpy AS VARCHAR)")} % {K_SMOTE} + 1 AS INTEGER) AS pick,
                {_h(SEED + 2, "CAST(vec_id AS VARCHAR) || ':' || CAST(cpy AS VARCHAR)")} / {float(1 << 32)} AS u
         FROM cp)
, rows AS (SELECT sy.syn_id, sy.vec_id AS base_id, knn.neighbour_id AS nbr_id, sy.u, sy.embedding AS a, nb.embedding AS b
           FROM sy JOIN knn ON knn.vec_id = sy.vec_id AND knn.nn_rank = sy.pick JOIN v nb ON nb.vec_id = knn.neighbour_id)
"""


@register("smote_rows", _SMOTE_SQL + """SELECT syn_id, base_id, nbr_id, round(u, 6) AS u,
  round(list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) + u * (CAST(b[i] AS DOUBLE) - CAST(a[i] AS DOUBLE)))), 6)
    AS coord_sum,
  round(CAST(a[1] AS DOUBLE) + u * (CAST(b[1] AS DOUBLE) - CAST(a[1] AS DOUBLE)), 6) AS x0 FROM rows""")
def smote_rows(spark, sf_dir):
    s = _smote(spark, sf_dir)
    return s.select("syn_id", "base_id", "nbr_id", F.round("u", 6).alias("u"),
                    F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("coord_sum"),
                    F.round(F.element_at("features", 1), 6).alias("x0"))


@register("smote_counts", f"""WITH cnt AS (SELECT count(*) FILTER (WHERE label = {MINORITY_LABEL}) AS mn,
  count(*) FILTER (WHERE label <> {MINORITY_LABEL}) AS mj FROM embeddings)
SELECT 1 AS is_minority, mn AS n_before, CAST(greatest(CAST(floor({RATIO} * mj) AS BIGINT), mn) AS BIGINT) AS n_after FROM cnt
UNION ALL SELECT 0, mj, mj FROM cnt""")
def smote_counts(spark, sf_dir):
    e = inputs.embeddings(spark, sf_dir)
    base = e.groupBy((F.col("label") == MINORITY_LABEL).cast("int").alias("is_minority")).agg(
        F.count(F.lit(1)).alias("n_before"))
    syn = _smote(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_syn")).withColumn("is_minority", F.lit(1))
    out = base.join(syn, "is_minority", "left")
    return out.select("is_minority", "n_before",
                      (F.col("n_before") + F.coalesce("n_syn", F.lit(0))).cast("long").alias("n_after"))


@register("scaler_stats", """WITH x AS (SELECT generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)
SELECT CAST(dim - 1 AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM x GROUP BY dim""")
def scaler_stats(spark, sf_dir):
    st = scaler_stats_long(inputs.embeddings(spark, sf_dir), "embedding")
    return st.select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("scaled_features", """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)
, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY dim)
SELECT vec_id, CAST(x.dim - 1 AS INTEGER) AS dim, round(CASE WHEN sd = 0 THEN 0.0 ELSE (v - m) / sd END, 6) AS value
FROM x JOIN s USING (dim)""")
def scaled_features(spark, sf_dir):
    sc = scale_long(inputs.embeddings(spark, sf_dir), "embedding", id_col="vec_id")
    return sc.select("vec_id", "dim", F.round("value", 6).alias("value"))
