"""Whitening of integer vectors by incremental eigendecomposition.

The fit list holds each distinct vector once.  A task keeps the mean and the
eigendecomposition of the scatter of the vectors it has seen; the next vector
is a rank-one update with its difference from that mean, whose eigenvalues are
the roots of a secular equation (entries that don't couple, and eigenvalues
that agree, are deflated first) and whose eigenvectors follow from the update
vector that fits those roots exactly.  Two spectra are combined by successive
rank-one updates, one for each eigenpair of the other and one for the
difference of the means, in a tree of joins that never brings more than
``fan`` spectra together.  Rayleigh-Ritz refinement ends it: the covariance
about the exact mean is projected on the basis found, in one more distributed
pass, and the small matrix's eigenvectors turn the basis into V's eigenvectors
in double precision.

Defined results: rows whose vector is null or holds null or non-finite entries
are left out; shorter vectors count as zero beyond their end; components whose
eigenvalue is zero to rounding (fewer distinct vectors than dimensions, or
constant ones) are not returned; a table with one distinct vector, or none, has
no rows; ``deviation`` is null if it does not fit a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Scratch

EPS = np.finfo(float).eps
LONG = 2**63 - 1


# ---- the spectrum of a sum of outer products, kept under rank-one updates

def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)) for ascending distinct ``d`` and non-zero ``z``, rho > 0.

    Root i lies between d_i and d_i+1 (the last one below d_n + rho |z|^2).  Each is held as the
    nearer pole and the distance from it: (origin indices, differences d_j - x_i as a matrix).
    All are iterated at once by fitting one pole on each side, within a shrinking bracket.
    """
    n = len(d)
    w = rho * z * z
    top = w.sum()
    ends = np.append(d[1:], d[-1] + top)
    gap = ends - d
    below = np.tri(n, dtype=bool)  # [i, j]: pole j is at or left of root i
    middle = d + gap / 2
    at_middle = 1 + (w / (d[None, :] - middle[:, None])).sum(axis=1)
    right = (at_middle < 0) & (np.arange(n) < n - 1)  # the root is nearer to the right pole
    origin = np.arange(n) + right
    delta = d[None, :] - d[origin][:, None]
    lo = np.where(right, -gap / 2, np.where(at_middle < 0, gap / 2, 0.0))
    hi = np.where(right, 0.0, np.where(at_middle < 0, gap, gap / 2))
    left_pole, right_pole = d - d[origin], ends - d[origin]
    x = (lo + hi) / 2
    for _ in range(60):
        t = delta - x[:, None]
        q = w / t
        f = 1 + q.sum(axis=1)
        q2 = q / t
        psi = np.where(below, q2, 0).sum(axis=1)
        phi = q2.sum(axis=1) - psi
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        a1, a2 = left_pole - x, right_pole - x
        c = f - a1 * psi - a2 * phi
        a = (a1 + a2) * f - a1 * a2 * (psi + phi)
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2)
        done = (np.abs(f) <= 8 * EPS * (1 + np.abs(q).sum(axis=1))) | (np.abs(new - x) <= 2 * EPS * np.abs(x)) | (hi - lo <= 2 * EPS * np.abs(x))
        x = np.where(done, x, new)
        if done.all():
            break
    return origin, delta - x[:, None]


class Spectrum:
    """Count, mean and eigendecomposition ``basis @ diag(values) @ basis.T`` of the scatter about that mean."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.values, self.basis = np.zeros(dim), np.eye(dim)

    def rank_one(self, v: np.ndarray, rho: float) -> None:
        """Add ``rho * outer(v, v)``, rho >= 0."""
        z = self.basis.T @ v
        size = rho * (z @ z)
        if not size > 0:
            return
        d = self.values
        tol = 8 * EPS * max(abs(d[-1]), size)
        # eigenvalues that agree: turn their vectors so that one of them alone meets the update
        close = np.diff(d) <= tol
        if close.any():
            starts = np.flatnonzero(~np.concatenate([[False], close]))
            for a, b in zip(starts, np.append(starts[1:], len(d))):
                if b - a > 1 and (norm := np.linalg.norm(z[a:b])) > 0:
                    h = z[a:b].copy()
                    sign = 1.0 if h[-1] >= 0 else -1.0
                    h[-1] += sign * norm
                    h /= np.linalg.norm(h)
                    self.basis[:, a:b] -= 2 * np.outer(self.basis[:, a:b] @ h, h)
                    z[a:b] = 0
                    z[b - 1] = -sign * norm
        live = np.flatnonzero(np.abs(z) * rho * np.sqrt(z @ z) > tol)
        if not len(live):
            return
        dl, zl = d[live], z[live]
        # (two of them may still be within rounding where a cluster's others were deflated)
        origin, diff = secular_roots(dl, zl, rho)
        k = len(live)
        # the update vector that has exactly these roots
        ratio = -diff / np.where(np.eye(k, dtype=bool), 1.0, dl[:, None] - dl[None, :])  # (x_i - d_j) / (d_i - d_j)
        fitted = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(zl)
        u = fitted[None, :] / diff
        u /= np.linalg.norm(u, axis=1)[:, None]
        values = d.copy()
        values[live] = dl[origin] - diff[np.arange(k), origin]
        self.basis[:, live] = self.basis[:, live] @ u.T
        order = np.argsort(values, kind="stable")
        self.values, self.basis = values[order], self.basis[:, order]

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self.rank_one(off, (self.n - 1) / self.n)

    def join(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        for value, v in zip(other.values, other.basis.T):
            if value > 0:
                self.rank_one(v, value)
        off, n = other.mean - self.mean, self.n + other.n
        self.rank_one(off, self.n * other.n / n)
        self.mean = self.mean + off * (other.n / n)
        self.n = n

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.basis.ravel()]).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, data: bytes, dim: int) -> Spectrum:
        x = np.frombuffer(data, "<f8")
        s = cls(dim)
        s.n, s.mean, s.values, s.basis = int(x[0]), x[1:dim + 1].copy(), x[dim + 1:2 * dim + 1].copy(), x[2 * dim + 1:].reshape(dim, dim).copy()
        return s


# ---- Spark

def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and ``x = floor(256 * entry)`` of the rows with finite vectors."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fine = "e IS NOT NULL AND forall(e, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    return v.where(F.coalesce(F.expr(fine), F.lit(False))).select("vec_id", F.transform("e", lambda c: F.floor(c * 256).cast("long")).alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    """(rows, dim) of a list column, zero beyond a list's end."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _tree(parts: DataFrame, merge, scratch: Scratch, fan: int = 8) -> bytes | None:
    """One ``data`` of all rows of ``parts`` (id of the task, data): joined ``fan`` at a time, by Spark, until one is left.
    ``merge`` takes an iterator of the packed values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": [int(pdf["id"].iat[0]) // fan], "data": [merge(pdf.sort_values("id")["data"])]})

    n = (parts.agg(F.max("id")).first()[0] or 0) + 1
    while n > 1:
        parts = scratch.table(parts.groupBy(F.floor(F.col("id") / fan).alias("g")).applyInPandas(run, "id long, data binary"))
        n = -(-n // fan)
    row = parts.first()
    return bytes(row["data"]) if row else None


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of every dimension."""

    def run(batches):
        n, total = 0, [0] * dim
        for b in batches:
            x = _matrix(b.column(0), dim)
            n += len(x)
            small = len(x) and int(np.abs(x.astype(float)).max(initial=0)) < 2**62 // len(x)
            part = x.sum(axis=0).tolist() if small else [sum(c) for c in x.T.tolist()]
            total = [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dim)], pa.int32()), pa.array([str(t) for t in (n, *total)])], ["i", "v"])

    got = {r["i"]: int(r["v"]) for r in fit.select("x").mapInArrow(run, "i int, v string")
           .groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(dim)]


def spectrum(fit: DataFrame, dim: int, scratch: Scratch) -> Spectrum | None:
    """The spectrum of the scatter of ``fit`` (x), by incremental updates in every task."""

    def run(batches):
        s = Spectrum(dim)
        for b in batches:
            for x in _matrix(b.column(0), dim).astype(float):
                s.add(x)
        if s.n:
            yield pa.RecordBatch.from_arrays([pa.array([s.pack()], pa.binary())], ["data"])

    def merge(packed) -> bytes:
        s = Spectrum(dim)
        for p in packed:
            s.join(Spectrum.unpack(p, dim))
        return s.pack()

    parts = fit.select("x").mapInArrow(run, "data binary").withColumn("id", F.spark_partition_id().cast("long"))
    data = _tree(scratch.table(parts), merge, scratch)
    return Spectrum.unpack(data, dim) if data else None


def centred_products(fit: DataFrame, dim: int, mean: np.ndarray, basis: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Sum of outer products of ``basis.T @ (x - mean)`` over ``fit``."""
    k = basis.shape[1]

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            x = _matrix(b.column(0), dim)
            for at in range(0, len(x), 4096):
                y = (x[at:at + 4096].astype(float) - mean) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    def merge(packed) -> bytes:
        return sum(np.frombuffer(p, "<f8") for p in packed).tobytes()

    parts = scratch.table(fit.select("x").mapInArrow(run, "data binary").withColumn("id", F.spark_partition_id().cast("long")))
    return np.frombuffer(_tree(parts, merge, scratch), "<f8").reshape(k, k)


class Whitener:
    """n, exact sums, components (columns, by falling eigenvalue), eigenvalues, trace and the check on the fit list."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.mean = np.array([s / n for s in sums])  # one rounding each
        self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - self.mean) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2."""
        most = self.n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(x.shape[1], 1) < 2**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(axis=1).tolist()
        out = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v <= LONG else None for v in out]


def fit_whitener(x: DataFrame, keep: int, scratch: Scratch) -> Whitener | None:
    """The whitener of the distinct vectors of ``x`` (x: array of long)."""
    spark = x.sparkSession
    dim = x.agg(F.max(F.size("x"))).first()[0]
    if not dim:
        return None
    # a shorter vector equals its padded form
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))
    fit = scratch.table(x.select(padded.alias("x")).distinct())
    # an update costs far more than the vector's bytes, so tasks are cut by rows
    fit = scratch.table(fit.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    n, sums = exact_sums(fit, dim)
    found = spectrum(fit, dim, scratch)
    mean = np.array([s / n for s in sums])
    basis = np.linalg.qr(found.basis[:, ::-1])[0]  # by falling eigenvalue
    values, turn = np.linalg.eigh(centred_products(fit, dim, mean, basis, scratch) / n)
    trace = float(values.sum())
    order = [i for i in np.argsort(-values, kind="stable")[:keep] if values[i] > 64 * dim * EPS * trace]
    if not order:
        return None
    components = basis @ turn[:, order]
    components /= np.linalg.norm(components, axis=0)
    out = Whitener(n, sums, components, values[order], trace)
    again = centred_products(fit, dim, mean, components / np.sqrt(out.values), scratch) / n
    out.identity_error = float(np.abs(again - np.eye(len(order))).max())
    return out


def whiten(vectors: DataFrame, keep: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row with a finite vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(whole(vectors))
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    w = fit_whitener(rows.select("x"), keep, scratch)
    if w is None:
        return spark.createDataFrame([], schema)
    k = len(w.values)
    share = w.values / w.trace

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), len(w.sums))
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array([w.n] * (m * k), pa.int64()),
                 pa.array(w.deviation(x), pa.int64()).take(take), pa.array(w.project(x).ravel()),
                 pa.array(np.tile(share, m)), pa.array([w.identity_error] * (m * k))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
