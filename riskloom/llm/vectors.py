"""Embedding near-duplicates: random-hyperplane signs, exact cosines, components.

Equal vectors of a label are one class with a multiplicity, so copies are never
compared.  A class has one signature of ``bits`` signs in each of ``tables``
tables; classes of one label that share a signature are compared by cosine in
double precision.  A pair is counted only in the first table in which its
signatures agree.  A bucket of more than ``block`` classes is cut into blocks
that meet two at a time, so no task holds more than two blocks; a comparison
returns link counts and a spanning forest, never its pairs.

At cosine 0.98 two signs differ with probability 0.0638; with 12 bits and 18
tables a pair at the threshold is missed with probability 2e-5.  The bits grow
with the logarithm of the number of vectors, so that a bucket of unlike vectors
stays small, and the tables with the bits, so that this probability stays.

Defined results: vectors that are null, empty or zero, hold null or non-finite
components, or have no label link with nothing; vectors of different length
never link; rows that repeat a vector link with each other; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise
from riskloom.llm.components import components


@functools.lru_cache(maxsize=8)
def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def signatures(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(rows, tables) signatures of the row vectors ``x``."""
    signs = (x @ hyperplanes(x.shape[1], bits, tables, seed) >= 0).reshape(len(x), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2).astype("<i4")


def _compare(rows, threshold: float, table: int, apart: bool):
    """Links of one block, or of two blocks with each other (``apart``: rows hold their block)."""
    x = np.frombuffer(b"".join(r["vec"] for r in rows), "<f8").reshape(len(rows), -1)
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), "<i4").reshape(len(rows), -1)
    mult = np.array([r["mult"] for r in rows], np.int64)
    side = np.array([r["block"] for r in rows]) if apart else None
    n_links, edges = np.zeros(len(rows), np.int64), []
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(rows), 512):
        near = x[at:at + 512] @ x.T >= threshold
        for k, row in enumerate(near):
            i = at + k
            j = np.flatnonzero(row[:i])
            if apart:
                j = j[side[j] != side[i]]
            if len(j) and table:
                j = j[~(sig[j, :table] == sig[i, :table]).any(axis=1)]
            if len(j):
                n_links[i] += mult[j].sum()
                n_links[j] += mult[i]
                for b in j.tolist():
                    p, q = find(i), find(b)
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        edges.append((i, b))
    return n_links, edges


def sizes_for(n: int, threshold: float, miss: float = 2e-5, bucket: int = 64, least: int = 12, most: int = 30) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors: about ``bucket`` unlike ones a bucket, and a pair at
    ``threshold`` in no common bucket of any table with probability ``miss`` at most."""
    bits = min(most, max(least, math.ceil(math.log2(max(n, 1) / bucket))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree)) if agree < 1 else 1


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, bits: int | None = None, tables: int | None = None,
                    block: int = 1024, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    fine = ("label IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
            "AND exists(e, x -> x != 0)")
    v = materialise(v.withColumn("ok", F.coalesce(F.expr(fine), F.lit(False))))
    classes = (v.where("ok").groupBy("label", "e").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
               .withColumn("cid", F.monotonically_increasing_id()))
    classes = materialise(classes)
    if bits is None or tables is None:
        bits, tables = sizes_for(classes.count(), threshold)

    def sign(batches):
        for b in batches:
            rows = b.to_pylist()
            out = {k: [] for k in ("cid", "mult", "label", "dim", "t", "s", "vec", "sig")}
            for dim in sorted({len(r["e"]) for r in rows}):
                own = [r for r in rows if len(r["e"]) == dim]
                x = np.array([r["e"] for r in own], float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                sig = signatures(x, bits, tables, seed)
                for i, r in enumerate(own):
                    for k, val in (("cid", r["cid"]), ("mult", r["mult"]), ("label", r["label"]), ("dim", dim),
                                   ("vec", x[i].astype("<f8").tobytes()), ("sig", sig[i].tobytes())):
                        out[k] += [val] * tables
                    out["t"] += range(tables)
                    out["s"] += sig[i].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (
                pa.int64(), pa.int64(), label_type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], list(out))

    from pyspark.sql.pandas.types import to_arrow_type

    label_type = to_arrow_type(v.schema["label"].dataType)
    signed = classes.select("cid", "mult", "label", "e").mapInArrow(
        sign, f"cid long, mult long, label {v.schema['label'].dataType.simpleString()}, dim int, t int, s int, vec binary, sig binary")
    key = ["label", "dim", "t", "s"]
    sizes = signed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    shared = signed.join(sizes, key)
    # blocks of a bucket, and the pairs (i, j) of blocks in which a block takes part
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    shared = shared.withColumn("nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    meets = F.explode(F.expr("transform(sequence(0, nb - 1), o -> struct(least(block, o) AS i, greatest(block, o) AS j))")).alias("m")
    groups = (shared.select(*key, "cid", "mult", "vec", "sig", "block", meets).groupBy(*key, "m")
              .agg(F.collect_list(F.struct("cid", "mult", "vec", "sig", "block")).alias("rows")).where(F.size("rows") > 1)
              .select("t", (F.col("m.i") != F.col("m.j")).alias("apart"), "rows"))

    def verify(batches):
        for b in batches:
            for t, apart, rows in zip(*(b.column(i) for i in range(3))):
                rows = rows.as_py()
                n, edges = _compare(rows, threshold, t.as_py(), apart.as_py())
                ids = np.array([r["cid"] for r in rows], np.int64)
                hit = np.flatnonzero(n)
                a = np.concatenate([ids[hit], ids[[e[0] for e in edges]] if edges else np.zeros(0, np.int64)])
                other = np.concatenate([ids[hit], ids[[e[1] for e in edges]] if edges else np.zeros(0, np.int64)])
                add = np.concatenate([n[hit], np.zeros(len(edges), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, other, add)], ["a", "b", "n"])

    found = materialise(groups.mapInArrow(verify, "a long, b long, n long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    roots = components(found.where("a != b").select("a", "b"))
    named = (classes.join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
             .select("label", "e", "low", F.coalesce("root", "cid").alias("root"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("label", "e", "n_links", "component_id")
    linked = v.where("ok").join(named, ["label", "e"]).select("vec_id", "n_links", "component_id")
    alone = v.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
