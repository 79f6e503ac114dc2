"""Exact k-nearest neighbours without a cross join, and local outlier factor.

Exact kNN (J1/J2) over any pair of inputs, in groups of bounded size:

* Equal vectors are one class.  Of a class only the ``k + 1`` smallest ids can be
  among a query's nearest, so only those enter the search (a limit that Spark
  applies before the shuffle), and equal queries are searched once.
* The reference rows are filed under the leaves of a tree of cuts, grown on a
  bounded sample of them, and a leaf is cut into parts of at most about ``block``
  rows.  The tree and the leaves' boxes (at most ``MAX_LEAVES``) go to every task.
* A query first meets one part of its own leaf; the distance of its k-th neighbour
  there bounds the true one, and rules out the leaves whose box is farther away.
  Every true neighbour is in one of the others.
* Where a query is left with ``FEW`` parts or less it is sent to them; parts meet
  their queries in blocks of at most about ``block`` queries, with one matrix
  product a block; the k nearest by (distance, id) within its bound of each query
  and part are merged by a second top-k.
* Else nothing is copied to the shuffle: a task holds some blocks of queries and
  reads the parts that one of them can reach as packed rows, keeps the k nearest so
  far and narrows its bounds by them.

Ties at the k-th distance are broken by neighbour id.  In high dimensions the
bound rules out less (distances concentrate); the result stays exact.  The
approximate ``lsh_candidates`` path is available for that regime.

Rows whose vector is null, holds null or non-finite entries, or has another
length than the reference's longest, have no neighbours and are nobody's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import exact_quantile, hash_key
from riskloom.session import cut_lineage

# sklearn-compatible guard added to the mean reachability distance (fixed value)
LRD_EPS = 1e-10
_SLACK = 1e-9
MAX_RINGS = 64
MAX_LEAVES, LEAF_SAMPLE = 2048, 32  # leaves of a tree, and rows of the sample for each
BLOCK = 4096
_CHUNK = 128  # queries of one matrix product, whose result stays in the processor's cache
_CELLS = 1 << 20  # numbers in one array of a search for parts
FEW = 2  # parts up to which queries are sent to them
_TASK_BLOCKS = 8  # blocks of queries that a task holds, at most about
_TASK_BYTES = 64 << 20  # packed references that a task reads at once


def as_double_vector(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _vectors(df: DataFrame, id_col: str, vec_col: str, names: tuple[str, str]) -> DataFrame:
    """Ids and finite vectors."""
    i, v = names
    out = df.select(F.col(id_col).cast("long").alias(i), as_double_vector(vec_col).alias(v))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.col(v).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(v) > 0))


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, dim))


def _numbers(packed: bytes, dim: int | None = None, kind=np.float64) -> np.ndarray:
    x = np.frombuffer(packed, kind)
    return x if dim is None else x.reshape(-1, dim)


def _outside(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distances of the rows to a box."""
    return np.sqrt(((np.maximum(lo - x, 0.0) + np.maximum(x - hi, 0.0)) ** 2).sum(axis=1))


class _Rings:
    """Pivots, and the parts that each cell's rings are cut into.  Bounded, so it travels with the tasks."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.bounds: list[np.ndarray] = [np.zeros(0)] * len(pivots)
        self.cell = self.lo = self.hi = self.first = self.parts = np.zeros(0)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1) if len(x) else np.zeros((0, len(self.pivots)))

    def ring(self, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), np.int64)
        for c in np.unique(cell):
            own = cell == c
            out[own] = np.searchsorted(self.bounds[c], d[own], side="right")
        return out

    def set_parts(self, rows: list[tuple[int, int, int, float, float]], block: int) -> None:
        """rows: (cell, ring, rows, least and greatest distance to the pivot)."""
        rows = sorted(rows)
        self.cell = np.array([r[0] for r in rows], np.int64)
        self.key = np.array([r[0] * (MAX_RINGS + 1) + r[1] for r in rows], np.int64)
        self.lo, self.hi = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        self.parts = np.array([-(-r[2] // block) for r in rows], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.parts)])[:-1].astype(np.int64)

    def part(self, ids: np.ndarray, cell: np.ndarray, ring: np.ndarray, nearest: bool = False) -> np.ndarray:
        """The part of each row; with ``nearest`` a ring without rows gives its neighbour's."""
        at = np.searchsorted(self.key, cell * (MAX_RINGS + 1) + ring)
        if nearest:
            at = np.minimum(at, len(self.key) - 1)
            at = np.where(self.cell[at] == cell, at, np.maximum(at - 1, 0))
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[at] + (mixed % self.parts[at].astype(np.uint64)).astype(np.int64)

    def reach(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """(queries, rings): whether a ring can hold a row within ``bound``."""
        to = d[:, self.cell]
        least = np.maximum(0.0, np.maximum(to - self.hi[None, :], self.lo[None, :] - to))
        bisector = (to - d.min(axis=1)[:, None]) / 2  # its rows are nearer to their own pivot
        # (distances carry rounding errors)
        return np.maximum(least, bisector) <= bound[:, None] + _SLACK * (1 + to)


class _Tree(_Rings):
    """Leaves of a tree of cuts as the cells, each with one ring; a leaf's box says how far away it is."""

    def __init__(self, sample: np.ndarray, leaves: int):
        super().__init__(sample[:0])
        self.dim, self.cut, self.below, self.leaf = [-1], [0.0], [0], [0]
        open_ = [(-len(sample), 0, np.arange(len(sample)))]  # the largest leaf is cut first
        n = 1
        while open_ and n < leaves:
            _, node, rows = heapq.heappop(open_)
            with np.errstate(over="ignore", invalid="ignore"):
                dim = int(np.nan_to_num(sample[rows].var(axis=0)).argmax())
            x = sample[rows, dim]
            cut = np.sort(x)[len(x) // 2]
            cut = cut if x.min() < cut else np.nextafter(cut, np.inf)
            if not (x >= cut).any():
                continue
            self.dim[node], self.cut[node], self.below[node] = dim, float(cut), len(self.dim)
            for side in (rows[x < cut], rows[x >= cut]):
                heapq.heappush(open_, (-len(side), len(self.dim), side))
                for of, v in ((self.dim, -1), (self.cut, 0.0), (self.below, 0), (self.leaf, 0)):
                    of.append(v)
            n += 1
        self.dim, self.cut, self.below = np.array(self.dim), np.array(self.cut), np.array(self.below)
        self.leaf = np.cumsum(self.dim < 0) - 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        going = np.flatnonzero(self.dim[node] >= 0)
        while len(going):
            at = node[going]
            node[going] = self.below[at] + (x[going, self.dim[at]] >= self.cut[at])
            going = going[self.dim[node[going]] >= 0]
        return self.leaf[node]

    def set_boxes(self, rows: list[tuple[int, list[float], list[float]]]) -> None:
        """rows: (part, least and greatest values); a leaf's box is that of its parts."""
        shape = (len(self.cell), len(rows[0][1]))
        self.box_lo, self.box_hi = np.full(shape, np.inf), np.full(shape, -np.inf)
        for part, lo, hi in rows:
            at = np.searchsorted(self.first, part, side="right") - 1
            self.box_lo[at], self.box_hi[at] = np.minimum(self.box_lo[at], lo), np.maximum(self.box_hi[at], hi)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_outside(x, lo, hi) for lo, hi in zip(self.box_lo, self.box_hi)], axis=1)

    def reach(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return d <= bound[:, None] * (1 + _SLACK)


def _top(qv: np.ndarray, rv: np.ndarray, rid: np.ndarray, want: int, bound: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query indexes, ids, distances) of the ``want`` nearest by (distance, id), with ``bound`` only those within a
    query's: a matrix product finds those that can be among them, exact differences decide."""
    rn, qn = (rv * rv).sum(axis=1), (qv * qv).sum(axis=1)
    pairs = max(1, _CELLS // rv.shape[1])  # of exact differences at once
    # the product is in single precision, unless its numbers don't fit; the slack is above its rounding errors
    kind = np.float32 if len(qv) and qn.max() + rn.max() < 1e30 else np.float64
    slack = 8 * (rv.shape[1] + 4) * np.finfo(kind).eps * (qn + rn.max()) + 1e-30
    limit = np.full(len(qv), np.inf) if bound is None else (bound * (1 + _SLACK)) ** 2 - qn + slack
    with np.errstate(over="ignore"):
        slack, limit = (np.nextafter(np.minimum(x, np.finfo(kind).max).astype(kind), kind(np.inf)) for x in (slack, limit))
    left, right = np.hstack([-2 * qv, np.ones((len(qv), 1))]).astype(kind), np.hstack([rv, rn[:, None]]).astype(kind).T
    for at in range(0, len(qv), _CHUNK):
        q = qv[at:at + _CHUNK]
        if len(rv) <= want:
            i, j = np.divmod(np.arange(len(q) * len(rv)), len(rv))
        else:
            g = left[at:at + _CHUNK] @ right  # squared distances less the queries' squares
            mask = g <= limit[at:at + _CHUNK, None]
            i, j = np.divmod(np.flatnonzero(mask), len(rv))
            many = np.flatnonzero(np.bincount(i, minlength=len(q)) > want)
            if len(many):
                cut = np.partition(g[many], want - 1, axis=1)[:, want - 1] + slack[at + many]
                mask[many] &= g[many] <= cut[:, None]
                i, j = np.divmod(np.flatnonzero(mask), len(rv))
        d = np.empty(len(i))
        for lo in range(0, len(i), pairs):
            diff = rv[j[lo:lo + pairs]] - q[i[lo:lo + pairs]]
            d[lo:lo + pairs] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        best = np.lexsort((rid[j], d, i))
        i, j, d = i[best], j[best], d[best]
        first = np.arange(len(i)) - np.searchsorted(i, i) < want
        yield at + i[first], rid[j[first]], d[first]


class _Best:
    """A block of queries, the ``want`` nearest of each so far and the bound they give."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, want: int):
        self.ids, self.x, self.bound, self.want = ids, x, bound.copy(), want
        self.dist, self.found = np.full((len(x), want), np.inf), np.zeros((len(x), want), np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, rv: np.ndarray, rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        near = np.flatnonzero(_outside(self.x, lo, hi) <= self.bound * (1 + _SLACK))
        for at, found, dist in _top(self.x[near], rv, rid, self.want, self.bound[near]):
            self.new.append((near[at], found, dist))
            self.held += len(at)
        if self.held > self.dist.size:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        at, found, dist = (np.concatenate(x) for x in zip(*self.new))
        rows = np.unique(at)
        at, found = np.concatenate([np.repeat(rows, self.want), at]), np.concatenate([self.found[rows].ravel(), found])
        dist = np.concatenate([self.dist[rows].ravel(), dist])
        order = np.lexsort((found, dist, at))
        at = at[order]
        first = order[np.arange(len(at)) - np.searchsorted(at, at) < self.want]
        self.dist[rows], self.found[rows] = dist[first].reshape(-1, self.want), found[first].reshape(-1, self.want)
        self.bound[rows] = np.minimum(self.bound[rows], self.dist[rows, -1])
        self.new, self.held = [], 0

    def rows(self) -> pa.RecordBatch:
        self.settle()
        i, j = np.nonzero(np.isfinite(self.dist))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.found[i, j]), pa.array(self.dist[i, j])], ["_qid", "_pid", "dist"])


def _sent(batch: pa.RecordBatch, rings: _Rings, dim: int, cells: int = _CELLS) -> Iterator[pa.RecordBatch]:
    """The queries of ``batch`` (id, vector, bound), each for every part that can hold one of its nearest,
    and its bound, with at most about ``cells`` numbers in an array at a time, however many rings or parts there are."""
    step = max(1, cells // max(1, len(rings.cell)))
    most = max(1, cells // dim)  # of the copies of queries sent at once
    for lo in range(0, len(batch), step):
        b = batch.slice(lo, step)
        d = rings.distances(_matrix(b.column(1), dim))
        at, ring = np.nonzero(rings.reach(d, b.column(2).to_numpy(zero_copy_only=False) * (1 + _SLACK)))
        again = np.repeat(np.arange(len(at)), rings.parts[ring])
        nth = np.arange(len(again)) - np.repeat(np.cumsum(rings.parts[ring]) - rings.parts[ring], rings.parts[ring])
        for i in range(0, len(again), most):
            some = again[i:i + most]
            take = pa.array(at[some])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(rings.first[ring[some]] + nth[i:i + most], pa.int64()),
                                              b.column(2).take(take)], ["_qid", "_qv", "part", "r"])


def _meet(queries: DataFrame, refs: DataFrame, kernel, schema: str, block: int) -> DataFrame:
    """``kernel`` on every part's references with each block of its queries.
    A part with no more queries than a block meets them once; else its rows are sent to every block."""
    queries = cut_lineage(queries)
    n = queries.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    qs = queries.join(n, "part").withColumn("b", F.pmod(F.xxhash64("_qid"), F.col("blocks")).cast("int"))
    rs = refs.join(n, "part").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    qs, rs = (d.select("part", "b", *[c for c in of.columns if c != "part"]).groupBy("part", "b") for d, of in ((qs, queries), (rs, refs)))
    return qs.cogroup(rs).applyInPandas(kernel, schema)


def _search(q: DataFrame, r: DataFrame, n: int, dim: int, want: int, k: int, n_pivots: int | None, seed: int, block: int) -> DataFrame:
    """(_qid, _pid, dist): for each query the ``want`` nearest by (distance, id) of every part that can hold one."""
    pairs = "_qid long, _pid long, dist double"

    def nearest(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or rs.empty:
            return pd.DataFrame({"_qid": [], "_pid": [], "dist": []})
        ids = qs["_qid"].to_numpy()
        r = qs["r"].to_numpy() if "r" in qs else None
        at, found, dist = (np.concatenate(x) for x in zip(*_top(_matrix(qs["_qv"], dim), _matrix(rs["_pv"], dim), rs["_pid"].to_numpy(), want, r)))
        return pd.DataFrame({"_qid": ids[at], "_pid": found, "dist": dist})

    p = min(n, n_pivots or -(-n // block))
    if p <= 1 and n <= block:
        return _meet(q.withColumn("part", F.lit(0).cast("long")), r.withColumn("part", F.lit(0).cast("long")), nearest, pairs, block)

    leaves = min(MAX_LEAVES, n_pivots or 2 * p)
    chosen = r.withColumn("_h", hash_key(seed, "_pid")).orderBy("_h", "_pid").limit(LEAF_SAMPLE * leaves).select("_pv").collect()
    tree = _Tree(np.array([c["_pv"] for c in chosen]), leaves)

    def cells(batches):
        for b in batches:
            cell = tree.file(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int64())], ["_pid", "_pv", "cell"])

    r = cut_lineage(r.mapInArrow(cells, "_pid long, _pv array<double>, cell long"))
    tree.set_parts([(c["cell"], 0, c["n"], 0.0, 0.0) for c in r.groupBy("cell").agg(F.count("*").alias("n")).collect()], block)

    def parted(batches):
        for b in batches:
            cell = b.column(2).to_numpy()
            part = tree.part(b.column(0).to_numpy(), cell, np.zeros_like(cell))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.int64())], ["_pid", "_pv", "part"])

    refs = r.mapInArrow(parted, "_pid long, _pv array<double>, part long")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(rows["_pv"], dim)
        return pd.DataFrame({"part": rows["part"].iloc[:1].to_numpy(), "rids": [rows["_pid"].to_numpy(np.int64).tobytes()], "rvs": [x.tobytes()],
                             "lo": [x.min(axis=0)], "hi": [x.max(axis=0)]})

    packed = refs.groupBy("part").applyInPandas(pack, "part long, rids binary, rvs binary, lo array<double>, hi array<double>")
    packed = cut_lineage(packed.repartition(max(1, -(-n * (dim + 1) * 8 // _TASK_BYTES))))
    tree.set_boxes([tuple(b) for b in packed.select("part", "lo", "hi").collect()])

    # first the part at home, for a bound
    def home(batches):
        for b in batches:
            cell = tree.file(_matrix(b.column(1), dim))
            part = tree.part(b.column(0).to_numpy(), cell, np.zeros_like(cell))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.int64())], ["_qid", "_qv", "part"])

    def reach(x: np.ndarray, r: np.ndarray) -> tuple[list[int], int]:
        """The parts that can hold a neighbour of one of the queries ``x``, and to how many they would be sent in sum."""
        hit, copies, step = np.zeros(len(tree.cell), bool), 0, max(1, _CELLS // len(tree.cell))
        for at in range(0, len(x), step):
            yes = tree.reach(tree.distances(x[at:at + step]), r[at:at + step])
            hit |= yes.any(axis=0)
            copies += int((yes * tree.parts).sum())
        return [part for i in np.flatnonzero(hit) for part in range(tree.first[i], tree.first[i] + tree.parts[i])], copies

    def bound(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty:
            return pd.DataFrame({c: [] for c in ("block", "qids", "qvs", "bounds", "reach", "copies")})
        ids, x, r = qs["_qid"].to_numpy(np.int64), _matrix(qs["_qv"], dim), np.full(len(qs), np.inf)
        if len(rs) and len(rv := _numbers(rs["rvs"].iloc[0], dim)) >= want:
            at, _, dist = (np.concatenate(x) for x in zip(*_top(x, rv, _numbers(rs["rids"].iloc[0], kind=np.int64), want)))
            last = np.flatnonzero(np.diff(at, append=-1))
            r[at[last]] = dist[last]
        parts, copies = reach(x, r)
        return pd.DataFrame({"block": [f"{qs['part'].iloc[0]}-{qs['b'].iloc[0]}"], "qids": [ids.tobytes()], "qvs": [x.tobytes()], "bounds": [r.tobytes()],
                             "reach": [parts], "copies": [copies]})

    blocks = cut_lineage(_meet(q.mapInArrow(home, "_qid long, _qv array<double>, part long"), packed.select("part", "rids", "rvs"), bound,
                               "block string, qids binary, qvs binary, bounds binary, reach array<long>, copies long", block))
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("copies").alias("copies"), F.sum(F.length("qids") / 8).alias("queries")).first()
    if not size["blocks"] or size["copies"] <= FEW * size["queries"]:
        def spread(batches):
            for b in batches:
                for ids, x, r in zip(*(b.column(c).to_pylist() for c in range(3))):
                    rows = pa.ListArray.from_arrays(np.arange(0, len(x) // 8 + 1, dim, dtype=np.int32), pa.array(_numbers(x)))
                    some = pa.RecordBatch.from_arrays([pa.array(_numbers(ids, kind=np.int64)), rows, pa.array(_numbers(r))], ["_qid", "_qv", "r"])
                    yield from _sent(some, tree, dim)

        sent = blocks.select("qids", "qvs", "bounds").mapInArrow(spread, "_qid long, _qv array<double>, part long, r double")
        return _meet(sent, refs, nearest, pairs, block)

    def search(batches):
        best: dict[str, _Best] = {}
        for b in batches:
            for block, ids, x, r, rids, rvs, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                if block not in best:
                    best[block] = _Best(_numbers(ids, kind=np.int64), _numbers(x, dim), _numbers(r), want)
                best[block].meet(_numbers(rvs, dim), _numbers(rids, kind=np.int64), np.array(lo), np.array(hi))
        for found in best.values():
            yield found.rows()

    cores = q.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(size["blocks"], 3 * cores), -(-size["blocks"] // _TASK_BLOCKS))
    # each block of queries beside each part it can reach; the parts of a task's blocks come one after another
    beside = blocks.repartition(tasks).hint("shuffle_replicate_nl").join(packed, F.expr("array_contains(reach, part)"))
    return beside.select("block", "qids", "qvs", "bounds", "rids", "rvs", "lo", "hi").coalesce(tasks).mapInArrow(search, pairs)


def knn(query: DataFrame, ref: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "features",
        exclude_self: bool = True, n_pivots: int | None = None, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Exact kNN: (``id_col``, neighbour_id, dist, nn_rank 1..k) for each query row.
    With ``exclude_self`` a row is no neighbour of the query with its id."""
    want = k + 1 if exclude_self else k
    own = Window.partitionBy("_pv").orderBy("_pid")
    r = _vectors(ref, id_col, vec_col, ("_pid", "_pv"))
    r = cut_lineage(r.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= want).drop("_n"))
    n, dim = r.agg(F.count("*"), F.max(F.size("_pv"))).first()
    rows = _vectors(query, id_col, vec_col, ("_qid", "_qv"))
    if not n:
        return rows.where("false").select(F.col("_qid").alias(id_col), F.col("_qid").alias("neighbour_id"), F.lit(0.0).alias("dist"), F.lit(0).alias("nn_rank"))
    r, rows = r.where(F.size("_pv") == dim), rows.where(F.size("_qv") == dim)
    classes = cut_lineage(rows.groupBy("_qv").agg(F.min("_qid").alias("_qid"), F.count("*").alias("_m")).select("_qid", "_qv", "_m"))
    found = _search(classes.select("_qid", "_qv"), r, n, dim, want, k, n_pivots, seed, block)
    best = Window.partitionBy("_qid").orderBy("dist", "_pid")
    found = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= want)
    top = found.groupBy("_qid").agg(F.sort_array(F.collect_list(F.struct("dist", "_pid"))).alias("_top"))  # at most `want` each
    if (classes.agg(F.max("_m")).first()[0] or 0) > 1:
        # copies of a query share its class's answer
        top = rows.join(classes.select(F.col("_qid").alias("_class"), "_qv"), "_qv").join(top.withColumnRenamed("_qid", "_class"), "_class")
    if exclude_self:
        top = top.withColumn("_top", F.filter("_top", lambda t: t["_pid"] != F.col("_qid")))
    out = top.select(F.col("_qid").alias(id_col), F.posexplode(F.slice("_top", 1, k)).alias("_at", "_t"))
    return out.select(id_col, F.col("_t._pid").alias("neighbour_id"), F.col("_t.dist").alias("dist"), (F.col("_at") + 1).cast("int").alias("nn_rank"))


# ---------------------------------------------------------------- local outlier factor

def _density(nn: DataFrame, kdist: DataFrame, id_col: str) -> DataFrame:
    """(id, lrd): one over the mean reachability distance to the neighbours."""
    reach = nn.join(kdist.select(F.col(id_col).alias("neighbour_id"), "kdist"), "neighbour_id")
    return reach.groupBy(id_col).agg((1.0 / (F.avg(F.greatest("kdist", "dist")) + F.lit(LRD_EPS))).alias("lrd"))


def _factor(nn: DataFrame, lrd_ref: DataFrame, lrd_own: DataFrame, id_col: str) -> DataFrame:
    """(id, lof, lrd): the neighbours' mean density against the row's own."""
    near = nn.join(lrd_ref.select(F.col(id_col).alias("neighbour_id"), F.col("lrd").alias("_near")), "neighbour_id")
    mean = near.groupBy(id_col).agg(F.avg("_near").alias("_mean"))
    return mean.join(lrd_own, id_col).select(id_col, (F.col("_mean") / F.col("lrd")).alias("lof"), "lrd")


class LofIndex:
    """ML10: a fitted local outlier factor (Breunig et al. 2000) that scores unseen rows.

    ``points`` holds every reference row with its vector, k-distance, density
    and own factor; ``threshold`` is the factor's quantile 1 - contamination over
    them.  An unseen row is compared with its ``k`` nearest points only; neither
    fitting nor scoring brings the points together anywhere."""

    def __init__(self, points: DataFrame, k: int, threshold: float | None, id_col: str):
        self.points, self.k, self.threshold, self.id_col = points, k, threshold, id_col

    @classmethod
    def fit(cls, points: DataFrame, k: int = 20, *, contamination: float = 0.013, id_col: str = "vec_id",
            vec_col: str = "features") -> LofIndex:
        vectors = _vectors(points, id_col, vec_col, (id_col, "features"))
        nn = cut_lineage(knn(vectors, vectors, k, id_col=id_col))
        kdist = cut_lineage(nn.groupBy(id_col).agg(F.max("dist").alias("kdist")))
        lrd = cut_lineage(_density(nn, kdist, id_col))
        own = _factor(nn, lrd, lrd, id_col)
        fitted = cut_lineage(vectors.join(kdist, id_col).join(own, id_col).select(id_col, "features", "kdist", "lrd", "lof"))
        return cls(fitted, k, exact_quantile(fitted, "lof", 1 - contamination), id_col)

    def training_scores(self) -> DataFrame:
        """(id, lof, is_outlier) of the reference rows, each without itself."""
        return self._judged(self.points.select(self.id_col, "lof"))

    def score(self, query: DataFrame, vec_col: str = "features") -> DataFrame:
        """(id, lof, is_outlier) of unseen rows: distances to the index's points, densities of the points."""
        i = self.id_col
        q = _vectors(query, i, vec_col, (i, "features"))
        nn = cut_lineage(knn(q, self.points, self.k, id_col=i, exclude_self=False))
        return self._judged(_factor(nn, self.points, _density(nn, self.points, i), i).select(i, "lof"))

    def _judged(self, scores: DataFrame) -> DataFrame:
        return scores.withColumn("is_outlier", (F.col("lof") > F.lit(self.threshold)).cast("int"))

    def save(self, path: str) -> None:
        """Points, then parameters; an index without parameters was not finished."""
        spark = self.points.sparkSession
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        spark.createDataFrame([(self.k, self.threshold, self.id_col)], "k int, threshold double, id_col string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LofIndex:
        p = spark.read.parquet(f"{path}/params").first()
        return cls(spark.read.parquet(f"{path}/points"), p["k"], p["threshold"], p["id_col"])


def lof(points: DataFrame, k: int = 20, *, id_col: str = "vec_id", vec_col: str = "features",
        query: DataFrame | None = None) -> DataFrame:
    """ML10 as one call: (id, lof, lrd).  With ``query`` None every point is scored against the
    others; otherwise query rows are scored against ``points`` (novelty mode)."""
    vectors = _vectors(points, id_col, vec_col, (id_col, "features"))
    nn = cut_lineage(knn(vectors, vectors, k, id_col=id_col))
    kdist = nn.groupBy(id_col).agg(F.max("dist").alias("kdist"))
    lrd = cut_lineage(_density(nn, kdist, id_col))
    if query is None:
        return _factor(nn, lrd, lrd, id_col)
    q = _vectors(query, id_col, vec_col, (id_col, "features"))
    found = cut_lineage(knn(q, vectors, k, id_col=id_col, exclude_self=False))
    return _factor(found, lrd, _density(found, kdist, id_col), id_col)


def lsh_candidates(query: DataFrame, ref: DataFrame, max_dist: float, *, id_col: str = "vec_id",
                   vec_col: str = "features", bucket_length: float = 1.0, tables: int = 4, seed: int = 42) -> DataFrame:
    """Approximate neighbour pairs (id, neighbour_id, dist) within ``max_dist``
    via Spark ML's bucketed random projection LSH; for very large reference
    sets where exact pruning cannot help.  Recall should be measured against
    ``knn`` on a sample."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def vecs(df):
        return df.select(id_col, array_to_vector(as_double_vector(vec_col)).alias("_v"))

    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_hashes", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(vecs(ref))
    j = model.approxSimilarityJoin(vecs(query), vecs(ref), max_dist, distCol="dist")
    return j.select(F.col(f"datasetA.{id_col}").alias(id_col), F.col(f"datasetB.{id_col}").alias("neighbour_id"),
                    "dist").filter(F.col(id_col) != F.col("neighbour_id"))
