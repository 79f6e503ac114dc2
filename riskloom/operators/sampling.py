"""Stratified split and folds, class weights and minority oversampling.

Ranks inside each class come from a seeded md5 hash of the row id, computed
with range-partitioned windows (``ranking.ranked``): the big class is spread
over hash ranges instead of one task, and the result is the same on any
cluster and in SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranking import HASH_RANGES, hash_key, hash_range, ranked, ranges_for


def class_ranks(df: DataFrame, label: str, key: str, seed: int = 42, out: str = "class_rank",
                rows: int | None = None) -> DataFrame:
    """0-based rank inside each class by seeded hash (ties by key).  ``rows``
    (largest class size) sets how many hash ranges split a class."""
    ranges = ranges_for(rows) if rows else HASH_RANGES
    h = df.withColumn("_h", hash_key(seed, key)).withColumn("_hr", hash_range(F.col("_h"), ranges))
    return ranked(h, [label], "_hr", ["_h", key], out=out).drop("_hr")


def stratified_split(df: DataFrame, label: str = "isFraud", key: str = "txn_id", test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """ML1: ``is_test`` = class rank (by seeded hash) < round(test_fraction * n_class)."""
    # class sizes come from a small aggregate (bounded by the number of classes)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    biggest = sizes.agg(F.max("_n")).first()[0] or 0
    r = class_ranks(df, label, key, seed, rows=biggest)
    r = r.join(sizes, label)
    n_test = F.round(F.col("_n") * F.lit(test_fraction), 0)
    return r.withColumn("is_test", (F.col("class_rank") < n_test).cast("int")).drop("_n", "_h")


def stratified_folds(df: DataFrame, label: str = "isFraud", key: str = "txn_id", k: int = 5,
                     seed: int = 42) -> DataFrame:
    """ML2: fold = class rank mod k, so every fold holds each class evenly."""
    biggest = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    r = class_ranks(df, label, key, seed, rows=biggest)
    return r.withColumn("fold", (F.col("class_rank") % k).cast("int")).drop("_h")


def oversample_plan(n_minority: int, n_majority: int, ratio: float = 0.5) -> int:
    """Synthetic rows needed so that minority = floor(ratio * majority)."""
    return max(int(math.floor(ratio * n_majority)) - n_minority, 0)


def smote(minority: DataFrame, neighbours: DataFrame, needed: int, n_minority: int, *, id_col: str = "vec_id",
          vec_col: str = "features", k: int = 5, seed: int = 42) -> DataFrame:
    """ML4: synthetic minority rows ``x + u * (nb - x)``.

    ``neighbours`` is the kNN table (id, neighbour_id, nn_rank 1..k) over the
    minority rows.  Base rows are taken round-robin by their seeded-hash rank
    (row r gets ``needed // n + (r < needed % n)`` copies), each copy picks one
    of its k neighbours and a gap ``u`` from a seeded hash of (id, copy): the
    output is repeatable and nothing runs on the driver but two counts."""
    if needed <= 0 or n_minority == 0:
        return minority.sparkSession.createDataFrame([], f"syn_id long, base_id long, nbr_id long, u double, "
                                                         f"{vec_col} array<double>")
    base, extra = divmod(needed, n_minority)
    r = class_ranks(minority.withColumn("_one", F.lit(1)), "_one", id_col, seed, out="_rank",
                    rows=n_minority).drop("_one")
    copies = F.lit(base) + (F.col("_rank") < extra).cast("int")
    rep = r.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).filter(copies > 0)
    pick_key = F.concat_ws(":", F.col(id_col).cast("string"), F.col("_copy").cast("string"))
    rep = rep.withColumns({
        "syn_id": F.col("_copy") * F.lit(n_minority) + F.col("_rank"),
        "nn_rank": (hash_key(seed + 1, pick_key) % k + 1).cast("int"),
        "u": hash_key(seed + 2, pick_key) / F.lit(float(1 << 32)),
    })
    nb = neighbours.select(F.col(id_col).alias("_bid"), F.col("neighbour_id").alias("nbr_id"), "nn_rank")
    rep = rep.join(nb, (rep[id_col] == nb["_bid"]) & (rep["nn_rank"] == nb["nn_rank"])).drop("_bid", nb["nn_rank"])
    vecs = minority.select(F.col(id_col).alias("nbr_id"), F.col(vec_col).alias("_nv"))
    rep = rep.join(vecs, "nbr_id")
    syn = F.zip_with(F.col(vec_col), F.col("_nv"), lambda a, b: a + F.col("u") * (b - a))
    return rep.select("syn_id", F.col(id_col).alias("base_id"), "nbr_id", "u", syn.alias(vec_col))
