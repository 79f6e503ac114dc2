"""SimHash near-duplicates by the generalised pigeonhole principle.

Every text gets a 64-bit fingerprint.  The bits are grouped into partitions so
that correlated bits stand together; partition ``i`` gets its own threshold
``t_i`` (-1: left out), with sum ``t_i = distance - partitions + 1``: of two
fingerprints within ``distance``, at least one partition then differs in at
most ``t_i`` bits.  The thresholds come from a dynamic programme over the
estimated number of probes and candidates.  A partition is probed by the
values within half of ``t_i`` on both sides; candidates that share a probe are
verified on all 64 bits.

Equal fingerprints are one class, so copies are never paired.  A probe value
shared by at most ``bucket`` classes is verified in one small task-local block,
which emits a spanning forest of its links.  Larger ones take another exact
way: each of their classes is listed under all 64-bit values within half the
distance, and those that share a value are linked to the smallest of them.

Defined results: a null or empty text has fingerprint zero, linked like any
other; repeated rows share a component; rows without a doc_id take the
component of their fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, materialise
from riskloom.llm.components import components

BITS = 64
BLOCK = 1 << 16  # shingles hashed at once


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of the word shingles; a bit is 1 if set in over half of the hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    n = len(words) - k + 1
    for at in range(0, n, BLOCK):
        m = min(n, at + BLOCK)
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:m].tolist(), ends[at + k - 1:m + k - 1].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and its fingerprint as a signed long, and columns of longs to ``carry`` along."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or "", shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64), pa.int64()), *b.columns[2:]], ["doc_id", "fp", *carry])

    return docs.select("doc_id", "text", *carry).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carry)))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(fingerprints, how many have bit i, how many have bits i and j) over all of them."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                both += x[at:at + (1 << 16)].T @ x[at:at + (1 << 16)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()])], ["n", "both"])

    parts = fps.select("fp").mapInArrow(run, "n long, both array<double>")
    sums = parts.select("n", F.posexplode("both").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r["i"]] = r["x"]
    both = both.reshape(BITS, BITS)
    return (sums[0]["n"] if sums else 0), np.diag(both).copy(), both


def group_bits(n: int, ones: np.ndarray, both: np.ndarray, parts: int) -> list[list[int]]:
    """Equal-sized groups of bits, each grown by the bit that correlates most with it."""
    p = ones / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    cor = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(cor, 0)
    left, out = set(range(BITS)), []
    for g in range(parts):
        size = math.ceil(len(left) / (parts - g))
        own = [max(sorted(left), key=lambda b: cor[b, sorted(left)].sum())]
        left -= set(own)
        while len(own) < size:
            own.append(max(sorted(left), key=lambda b: cor[b, own].sum()))
            left.discard(own[-1])
        out.append(sorted(own))
    return out


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def costs(n: int, ones: np.ndarray, group: list[int], most: int, per_pair: float = 0.5) -> list[float]:
    """Estimated work of one partition for thresholds -1 to ``most``: probes, and pairs
    that differ in at most so many of its bits (bits taken as independent)."""
    p = ones[group] / max(n, 1)
    dist = np.zeros(len(group) + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):  # chance that two fingerprints differ in this bit
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    near = np.cumsum(dist)
    return [0.0] + [n * ball(len(group), (t + 1) // 2) + per_pair * n * (n - 1) / 2 * near[min(t, len(group))] for t in range(most + 1)]


def allocate(table: list[list[float]], distance: int) -> list[int]:
    """Thresholds of the least total cost with sum ``distance - partitions + 1``."""
    parts = len(table)
    want = distance - parts + 1 + parts  # each threshold plus one
    best: list[dict[int, tuple[float, tuple[int, ...]]]] = [{0: (0.0, ())}]
    for row in table:
        nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, ts) in best[-1].items():
            for t, c in enumerate(row):
                if used + t <= want and (cost + c, ts + (t - 1,)) < nxt.get(used + t, (math.inf, ())):
                    nxt[used + t] = (cost + c, ts + (t - 1,))
        best.append(nxt)
    return list(best[-1][want][1])


def masks(bits: list[int], radius: int) -> list[int]:
    out = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``distance`` among a bounded block."""
    u = fps.view(np.uint64)
    root = list(range(len(u)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(1, len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= distance).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(fps[j])))
    return out


def links(fps: DataFrame, distance: int = 4, parts: int = 2, bucket: int = 4096) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``fps`` that connect exactly
    those within ``distance`` bits (directly or through others within it)."""
    n, ones, both = bit_statistics(fps)
    groups = group_bits(n, ones, both, parts)
    thresholds = allocate([costs(n, ones, g, distance) for g in groups], distance)
    probes = []
    for i, (g, t) in enumerate(zip(groups, thresholds)):
        if t >= 0:
            own = signed(sum(1 << b for b in g))
            keys = F.explode(F.array(*[F.lit(m) for m in masks(g, (t + 1) // 2)])).alias("m")
            probes.append(fps.select("fp", keys).select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(own)).bitwiseXOR(F.col("m")).alias("key"), "fp"))
    rows = probes[0]
    for p in probes[1:]:
        rows = rows.union(p)
    # buckets with company; first counted, so that no large one is ever brought together
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(rows.join(sizes, ["part", "key"]))

    def verify(batches):
        for b in batches:
            found = [e for x in b.column(0).to_pylist() for e in _forest(np.array(x, np.int64), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    small = (shared.where(F.col("n") <= bucket).groupBy("part", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
             .select("fps").distinct().mapInArrow(verify, "a long, b long"))
    large = shared.where(F.col("n") > bucket).select("fp").distinct()
    return small.union(_balls(large, distance))


def _balls(fps: DataFrame, distance: int) -> DataFrame:
    """Links among many fingerprints: two lie within an even ``distance`` exactly if the
    balls of half of it around them share a value, and all that share one are linked
    to the smallest.  (An odd distance adds the links across one more bit.)"""
    half = distance // 2
    near = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks(list(range(BITS)), half)])).alias("m"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
    low = near.groupBy("v").agg(F.min("fp").alias("a"))
    star = near.join(low, "v").where("a != fp").select("a", F.col("fp").alias("b")).distinct()
    if distance % 2:
        # balls of radius half + 1 on one side reach those of radius half on the other
        wide = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks(list(range(BITS)), half + 1)])).alias("m"))
        wide = wide.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("v"))
        star = star.union(wide.join(low, "v").where("a != fp").select("a", F.col("fp").alias("b")).distinct())
    return star


def _rooted(prints: DataFrame, distance: int, parts: int, bucket: int) -> DataFrame:
    """(fp, low, root): every fingerprint with its smallest doc_id and its component's smallest fingerprint."""
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = materialise(components(links(classes.select("fp"), distance, parts, bucket)))
    return classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, parts: int = 2, bucket: int = 4096) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs`` (doc_id, text)."""
    prints = materialise(fingerprints(docs, shingle))
    named = _rooted(prints, distance, parts, bucket)
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, parts: int = 2, bucket: int = 4096) -> DataFrame:
    """``docs`` with exactly one row of each component: that of its smallest doc_id, of rows
    that share it the one whose text has the smallest hash; a component without any id keeps
    the row of the smallest hash.  Rows that repeat an id and a text count once."""
    prints = materialise(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), shingle, ("text_key",)))
    rooted = prints.join(_rooted(prints, distance, parts, bucket).select("fp", "root"), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    own, key, text_key = fresh(docs, "own", "key", "text_key")
    chosen = rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias(own), F.col("first.text_key").alias(key)).distinct()
    out = docs.withColumn(text_key, F.xxhash64("text"))
    out = out.join(chosen, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(text_key) == F.col(key)), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]).select(docs.columns)
