"""kNN exactness on clustered data, LOF novelty mode, LSH recall vs exact."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.operators import neighbors as NB


def _points(spark, n=400, d=8, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(scale=6.0, size=(5, d))
    x = centers[rng.integers(0, 5, n)] + rng.normal(size=(n, d))
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "vec_id long, features array<double>"), x


def test_knn_exact_against_numpy(spark):
    df, x = _points(spark)
    got = {(r["vec_id"], r["nn_rank"]): r["neighbour_id"] for r in NB.knn(df, df, 7).collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (d[i, j], j))[:7]
        assert [got[(i, r + 1)] for r in range(7)] == order


def _brute(q, r, k, exclude_self):
    out = {}
    for i, v in q:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in r if not (exclude_self and i == j))
        out[i] = [j for _, j in d[:k]]
    return out


def _ranks(df):
    out = {}
    for r in df.orderBy("vec_id", "nn_rank").collect():
        out.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    return out


@pytest.mark.parametrize("exclude_self", [True, False])
def test_knn_in_cells_rings_and_blocks(spark, exclude_self):
    """Small blocks: several pivots, rings, parts and query blocks; a third of the rows are one vector."""
    rng = np.random.default_rng(9)
    x = [(i, [float(a) for a in v]) for i, v in enumerate(rng.integers(0, 6, (240, 3)))]
    x += [(1000 + i, [2.0, 2.0, 2.0]) for i in range(120)]
    q = x[::3] + [(5000, [2.0, 2.0, 2.0]), (5001, [40.0, 0.0, 0.0])]
    schema = "vec_id long, features array<double>"
    got = NB.knn(spark.createDataFrame(q, schema), spark.createDataFrame(x, schema), 4, exclude_self=exclude_self, block=16)
    assert _ranks(got) == _brute(q, x, 4, exclude_self)


def test_knn_of_copies_gives_k_rows_each(spark):
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("features"))
    rows = NB.knn(same, same, 5).groupBy("vec_id").agg(F.count("*").alias("n"), F.max("dist").alias("d")).groupBy("n", "d").count().collect()
    assert [tuple(r) for r in rows] == [(5, 0.0, 3000)]


def test_knn_limits_copies_before_the_shuffle(spark):
    """The rows of one vector are cut to k + 1 in the task that reads them."""
    df, _ = _points(spark, n=50)
    own = NB.Window.partitionBy("features").orderBy("vec_id")
    plan = df.withColumn("n", F.row_number().over(own)).where("n <= 6")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_knn_of_odd_rows(spark):
    schema = "vec_id long, features array<double>"
    good = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 3.0])]
    odd = [(4, None), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [1.0]), (8, []), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(good + odd, schema)
    assert _ranks(NB.knn(df, df, 5)) == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    none = spark.createDataFrame([], schema)
    assert NB.knn(df, none, 2).collect() == [] and NB.knn(none, df, 2).collect() == []


def test_lof_index_saved_and_loaded(spark, scratch):
    df, x = _points(spark)
    train, test = df.filter("vec_id % 4 > 0"), df.filter("vec_id % 4 = 0")
    far = spark.createDataFrame([(10_000, [50.0] * x.shape[1])], "vec_id long, features array<double>")
    index = NB.LofIndex.fit(train, 10, contamination=0.05)
    index.save(scratch)
    again = NB.LofIndex.load(spark, scratch)
    asked = test.union(far)
    a, b = ({r["vec_id"]: (r["lof"], r["is_outlier"]) for r in i.score(asked).collect()} for i in (index, again))
    assert {i: (pytest.approx(v), o) for i, (v, o) in a.items()} == b and a[10_000][1] == 1 and len(a) == 101
    want = {r["vec_id"]: r["lof"] for r in NB.lof(train, 10, query=asked).collect()}
    assert {i: pytest.approx(v[0]) for i, v in a.items()} == want
    own = index.training_scores()
    assert own.count() == train.count() and 0 < own.filter("is_outlier = 1").count() <= 0.06 * train.count()


def test_lof_novelty_flags_planted_query(spark):
    df, x = _points(spark)
    q = spark.createDataFrame([(10_000, [50.0] * x.shape[1]), (10_001, [float(v) for v in x[0]])],
                              "vec_id long, features array<double>")
    s = {r["vec_id"]: r["lof"] for r in NB.lof(df, 20, query=q).collect()}
    assert s[10_000] > 5 and s[10_001] < 2


def test_lsh_candidates_recall(spark):
    df, x = _points(spark)
    exact = NB.knn(df, df, 5)
    radius = exact.agg(F.max("dist")).first()[0]
    approx = NB.lsh_candidates(df, df, radius, bucket_length=2.0, tables=6)
    hit = exact.join(approx.select("vec_id", "neighbour_id", F.col("dist").alias("d2")), ["vec_id", "neighbour_id"])
    recall = hit.count() / exact.count()
    assert recall > 0.5
    assert hit.filter(F.abs(F.col("dist") - F.col("d2")) > 1e-9).count() == 0


def test_queries_are_sent_to_parts_in_small_batches():
    rng = np.random.default_rng(5)
    rings = NB._Rings(rng.normal(size=(40, 8)))
    rings.set_parts([(c, r, 3000, 0.1 * r, 0.1 * r + 3.0) for c in range(40) for r in range(5)], 1000)
    x = rng.normal(size=(300, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(x.tolist()), pa.array([1.0] * 300)], ["_qid", "_qv", "r"])
    sent = list(NB._sent(batch, rings, 8, cells=2000))
    assert max(len(b) for b in sent) <= 2000 // 8
    reach = rings.reach(rings.distances(x), np.full(300, 1.0 + NB._SLACK))
    want = {(i, int(rings.first[j]) + n) for i, j in zip(*np.nonzero(reach)) for n in range(3)}
    got = [(q, p) for b in sent for q, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    assert len(got) == len(want) and set(got) == want
    assert all(b.column(1).to_pylist() == x[b.column(0).to_numpy()].tolist() for b in sent[:20])


def test_a_part_gives_only_neighbours_within_the_bound():
    rng = np.random.default_rng(6)
    refs, queries, ids = rng.integers(-9, 9, (900, 4)) * 1.0, rng.integers(-9, 9, (200, 4)) * 1.0, rng.permutation(900)
    d = np.sqrt(((queries[:, None, :] - refs[None, :, :]) ** 2).sum(axis=2))
    bound = np.quantile(d, 0.003, axis=1)
    at, found, dist = (np.concatenate(x) for x in zip(*NB._top(queries, refs, ids, 5, bound)))
    want = [(i, int(ids[j]), d[i, j]) for i in range(200) for j in np.lexsort((ids, d[i]))[:5] if d[i, j] <= bound[i]]
    assert [(a, b) for a, b, _ in want] == list(zip(at.tolist(), found.tolist())) and len(want) < 1000
    assert np.allclose([x for *_, x in want], dist, atol=1e-12)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[0.0] * 4, [1.0] * 4]), pa.array([0.5, 9.0])], ["_qid", "_qv", "r"])
    rings = NB._Rings(np.zeros((1, 4)))
    rings.set_parts([(0, 0, 900, 0.0, 5.0)], 400)
    sent = pa.Table.from_batches(list(NB._sent(batch, rings, 4))).to_pydict()
    assert {(q, r) for q, r in zip(sent["_qid"], sent["r"])} == {(1, 0.5), (2, 9.0)}


@pytest.mark.parametrize("few", [0, 1000])
def test_knn_of_rows_without_clusters_is_exact_and_copies_few_rows(spark, monkeypatch, few):
    """Every query can reach most parts: with few copies allowed, what is stored stays in proportion to the rows."""
    rng = np.random.default_rng(4)
    x = [(i, [float(a) for a in v]) for i, v in enumerate(rng.integers(-9, 10, (500, 12)))]
    x += [(900 + i, [v * 2.0**66 for v in x[i][1]]) for i in range(30)]
    df = spark.createDataFrame(x, "vec_id long, features array<double>")
    stored, cut = [], NB.cut_lineage

    def counted(rows):
        stored.append((rows := cut(rows)).count())
        return rows

    monkeypatch.setattr(NB, "cut_lineage", counted)
    monkeypatch.setattr(NB, "FEW", few)
    assert _ranks(NB.knn(df, df, 4, block=16)) == _brute(x, x, 4, True)
    assert few or sum(stored) < 8 * len(x)


def test_a_tree_files_every_row_in_a_leaf_of_its_box():
    rng = np.random.default_rng(8)
    sample = np.column_stack([rng.integers(0, 2, 300) * 9.0, rng.normal(size=300), np.full(300, 3.0)])
    tree = NB._Tree(sample, 20)
    cell = tree.file(sample)
    assert len(np.unique(cell)) == 20 and np.bincount(cell).max() <= 40
    tree.set_parts([(c, 0, int(n), 0.0, 0.0) for c, n in enumerate(np.bincount(cell))], 7)
    part = tree.part(np.arange(300), cell, np.zeros_like(cell))
    tree.set_boxes([(int(p), sample[part == p].min(axis=0).tolist(), sample[part == p].max(axis=0).tolist()) for p in np.unique(part)])
    q = rng.normal(scale=5.0, size=(50, 3))
    d = np.sqrt(((q[:, None, :] - sample[None]) ** 2).sum(axis=2))
    yes = tree.reach(tree.distances(q), d.min(axis=1))
    assert yes[np.arange(50), cell[d.argmin(axis=1)]].all() and yes.mean() < 0.8
    one = NB._Tree(np.ones((9, 2)), 4)
    assert one.file(np.zeros((3, 2))).tolist() == [0, 0, 0]
