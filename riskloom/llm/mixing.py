"""Mixing sources to target weights by fitting subset sums.

Every source gets a share of the words of all rows by its weight, at most
``most`` times its own words; what that limit cuts off is shared anew by weight.
Within a source every document is taken ``floor(target / words)`` times, and
some of them once more.  Which ones is planned on the count of documents of
each exact length: a share of every length by proportion, and bounded-knapsack
dynamic programming for the last ``window`` words.  Of each length the planned
number of documents is then selected in a seeded order.

A budget up to ``window`` words is fitted wholly by dynamic programming, so the
taken words are the nearest sum that exists; a larger one is met to the word
wherever the last ``window`` words can be made from what the proportion left.

Defined results: a null or empty text has no words and nothing is taken; rows
without a source are one source, the last; rows that repeat an id are told
apart by their texts, and equal rows are interchangeable; an empty table has no
rows.  Reruns agree whatever the partitions.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Scratch
from riskloom.llm.ranks import positions

SIZED = "doc_id {id}, source string, size long, pick long, text_key long"


def count_words(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each string of a batch (null: 0)."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0]:off[-1]] if n else np.zeros(0, np.uint8)
    off = off - (off[0] if n else 0)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    starts = off[:-1]
    before[starts[starts < len(data)]] = True  # a text starts a word whatever stands before it
    begins = before & ~space
    # (a null has no bytes)
    return np.array([np.count_nonzero(begins[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.int64)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, and the keys of the seeded order."""
    key = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text",
                      F.xxhash64(F.lit(seed), "doc_id").alias("pick"), F.xxhash64("text").alias("text_key"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count_words(b.column(2)), pa.int64()), b.column(3), b.column(4)],
                                             ["doc_id", "source", "size", "pick", "text_key"])

    return key.mapInArrow(run, SIZED.format(id=docs.schema["doc_id"].dataType.simpleString()))


def targets(sources: DataFrame, most: int) -> tuple[DataFrame, int, int]:
    """``sources`` (words, weight, ...) with their target, and (rest, weights): a
    source that is not at its limit gets ``rest * weight / weights``.

    Each round shares what the limits of the last one leave; the share of a unit
    of weight only grows, so a source that reached its limit stays there.
    """
    words, share = F.col("words").cast("decimal(38,0)"), F.col("weight")
    total, weights = sources.agg(F.sum(words), F.sum(share)).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0)), 0, 1
    total, weights = int(total), int(weights)
    rest = total

    def above(rest: int, weights: int):
        return F.lit(rest).cast("decimal(38,0)") * share > words * F.lit(most) * F.lit(weights)

    while True:
        full = above(rest, weights)
        at_limit, left = sources.agg(F.sum(F.when(full, words * most)), F.sum(F.when(~full, share))).first()
        now = total - int(at_limit or 0), int(left or 0)
        if now == (rest, weights):
            break
        rest, weights = now
    return sources.withColumn("target", F.when(above(rest, weights), (words * most).cast("double"))
                              .otherwise(F.lit(float(rest)) * share / F.lit(float(weights)))), rest, weights


def nearest_sum(sizes: np.ndarray, counts: np.ndarray, budget: Fraction) -> np.ndarray:
    """How many of each size to take (at most ``counts``) so that their sum comes nearest to ``budget``
    (of two equally near ones the lower): bounded knapsack by binary parts, each sum
    reached first by one part, so that the parts of a sum can be read back."""
    taken = np.zeros(len(sizes), np.int64)
    top = int(2 * budget) + 1  # nothing taken is as near as any sum beyond
    aim = -int(-(budget - Fraction(1, 2)) // 1)  # the nearest whole number, the lower of two
    by = np.full(top + 1, -1, np.int32)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    parts = []
    for i in np.argsort(-sizes, kind="stable"):
        left, step = min(int(counts[i]), top // int(sizes[i])), 1
        while left > 0:
            parts.append((int(i), min(step, left)))
            left -= step
            step *= 2
    for p, (i, times) in enumerate(parts):
        if reached[aim]:
            break
        add = int(sizes[i]) * times
        if add <= top:
            fresh = np.flatnonzero(reached[:top + 1 - add] & ~reached[add:]) + add
            by[fresh] = p
            reached[fresh] = True
    sums = np.flatnonzero(reached)
    k = int(np.searchsorted(sums, aim))
    at = min(sums[max(0, k - 1):k + 2].tolist(), key=lambda s: (abs(s - budget), s))
    while at:
        i, times = parts[by[at]]
        taken[i] += times
        at -= int(sizes[i]) * times
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: Fraction, window: int) -> np.ndarray:
    """How many documents of each size (positive, ascending) to take for ``budget`` words."""
    total = sum(int(a) * int(b) for a, b in zip(sizes, counts))
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.zeros(len(sizes), np.int64)
    if budget > window:
        keep = window // 2  # left to the dynamic programming
        share = (budget - keep) / total
        exact = [int(c) * share for c in counts]
        taken = np.array([int(x) for x in exact], np.int64)
        budget -= sum(int(a) * int(b) for a, b in zip(sizes, taken))
        for i in sorted(range(len(sizes)), key=lambda i: (int(exact[i]) - exact[i], -sizes[i])):
            if taken[i] < counts[i] and budget - int(sizes[i]) >= keep:
                taken[i] += 1
                budget -= int(sizes[i])
    return taken + nearest_sum(sizes, counts - taken, budget)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, window: int = 1 << 16, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of
    ``docs`` (doc_id, source, text); the sources in order of code points, null last, get ``weights`` in turn."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # never null: a name after "=", then the rows without one
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))
    rows = scratch.table(sized(docs, seed).withColumn("name", name).drop("source"))
    classes = scratch.table(rows.groupBy("name", "size").agg(F.count("*").alias("n")))
    sources = classes.groupBy("name").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("all", F.lit(0))
    sources = scratch.table(positions(scratch.table(sources), ["all"], ["name"], scratch))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    sources, rest, shares = targets(sources.withColumn("weight", turn), most)
    sources = scratch.table(sources.drop("all", "pos"))

    def plan(h: pd.DataFrame) -> pd.DataFrame:
        h = h.sort_values("size", ignore_index=True)
        words, weight = int(h["words"].iat[0]), int(h["weight"].iat[0])
        target = min(Fraction(rest * weight, shares), Fraction(most * words))
        copies = min(most, int(target / words)) if words else 0
        some = h["size"].to_numpy() > 0
        extra = np.zeros(len(h), np.int64)
        if words and copies < most:
            extra[some] = fit(h["size"].to_numpy()[some], h["n"].to_numpy()[some], target - copies * words, window)
        return h[["name", "size", "words", "target"]].assign(copies=copies, extra=extra)

    planned = classes.join(sources, "name").groupBy("name").applyInPandas(
        plan, "name string, size long, words long, target double, copies long, extra long")
    placed = positions(rows, ["name", "size"], ["pick", "doc_id", "text_key"], scratch)
    copies = F.col("copies") + F.when(F.col("pos") < F.col("extra"), 1).otherwise(0)
    return (placed.join(scratch.table(planned), ["name", "size"])
            .select("doc_id", F.when(F.col("name") != "~", F.substring("name", 2, 2**31 - 1)).alias("source"), "size",
                    F.col("words").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))
