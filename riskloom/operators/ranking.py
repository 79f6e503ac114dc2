"""Distributed ranks, prefix sums and exact quantiles.

A global ``row_number() OVER (ORDER BY ...)`` or an exact percentile runs in a
single task.  These helpers split the order into ranges (``range_id``) that are
monotone in the order, compute range-local values with windows partitioned by
range, and add per-range offsets from a small (ranges x groups) table.  Each
task sees one range; nothing passes through the driver except bounded range
boundaries and range totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_RANGES = 256
ROWS_PER_RANGE = 4_000_000   # target rows per range task


def ranges_for(rows: int, minimum: int = HASH_RANGES) -> int:
    """Power-of-two range count so that a range holds about ROWS_PER_RANGE rows, whatever their number."""
    need = max(minimum, -(-int(rows) // ROWS_PER_RANGE))
    return 1 << (need - 1).bit_length()


def hash_key(seed: int, key) -> Column:
    """Deterministic 32-bit hash of (seed, key) from md5, identical in SQL engines:
    ``CAST('0x' || substr(md5('<seed>:' || key), 1, 8) AS BIGINT)``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 8), 16, 10).cast("long")


def hash_range(h: Column, ranges: int = HASH_RANGES) -> Column:
    """Monotone range id of a 32-bit hash (top bits)."""
    return (h / F.lit((1 << 32) // ranges)).cast("int")


def ranked(df: DataFrame, group_cols: list[str], range_col: str, order_cols: list[str],
           out: str = "rank0") -> DataFrame:
    """0-based rank within ``group_cols`` by (range_col, *order_cols).

    ``range_col`` must be monotone in the order.  Range totals have a row for each
    group and range; Spark broadcasts them only while they are small."""
    totals = df.groupBy(*group_cols, range_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, range_col, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*group_cols, range_col).orderBy(*order_cols)
    with_local = df.withColumn("_local", F.row_number().over(local) - 1)
    return (with_local.join(offsets, [*group_cols, range_col])
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("long")).drop("_off", "_local"))


def with_range(df: DataFrame, col: str, bounds: list[float], out: str = "_r") -> DataFrame:
    """Add the index of the value range holding ``col`` (number of inner
    boundaries <= value), by binary search in the JVM (Spark ML Bucketizer)."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *sorted(set(float(b) for b in bounds)), float("inf")]
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def exact_quantile(df: DataFrame, col: str, q: float, ranges: int = 64, rel_err: float = 0.001,
                   max_local: int = 2_000_000) -> float | None:
    """Exact linear-interpolated quantile (position q*(n-1)), as Spark's
    ``percentile`` and SQL ``quantile_cont`` define it, without sorting all
    rows in one task: distinct values with counts (partial aggregation), range
    totals, then a window over the one or two ranges that hold the target ranks.
    Ranges that are still large are split again."""
    from riskloom.session import cut_lineage

    vals = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # distinct values with counts, materialised once: every later pass reads this
    counts = cut_lineage(vals.groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    n = counts.agg(F.sum("c")).first()[0]
    if not n:
        return None
    pos = q * (n - 1)
    lo_rank = int(pos)
    frac = pos - lo_rank
    targets = sorted({lo_rank, min(lo_rank + 1, n - 1)})

    found: dict[int, float] = {}
    todo = [(counts, 0, targets)]
    while todo:
        scope, offset, wanted = todo.pop()
        probs = [i / ranges for i in range(1, ranges)]
        bounds = sorted(set(x for x in scope.approxQuantile("v", probs, rel_err) if x is not None))
        tagged = with_range(scope, "v", bounds)
        tot = sorted((r["_r"], r["n"], r["d"]) for r in
                     tagged.groupBy("_r").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d")).collect())
        start = offset
        for rid, cnt, distinct in tot:
            hit = [t for t in wanted if start <= t < start + cnt]
            part = tagged.filter(F.col("_r") == rid)
            # a range that is still large is split again, unless it can't be
            if hit and distinct > max_local and len(tot) > 1:
                todo.append((part.drop("_r"), start, hit))
            elif hit:
                w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
                part = part.withColumn("_cum", F.sum("c").over(w) + F.lit(start))
                for t in hit:
                    found[t] = part.filter(F.col("_cum") > t).agg(F.min("v")).first()[0]
            start += cnt
    lo = found[targets[0]]
    hi = found[targets[-1]]
    return lo + frac * (hi - lo)
