"""Best-fit packing of token sequences with large-item matching.

Whether two pieces fit together depends on their lengths alone, so the packing
is made on the histogram of lengths (at most ``capacity`` rows, whatever the
corpus) and every piece then finds its place by its rank among the pieces of
its length.  ``plan`` works from the longest length down: pieces above a third
of the capacity (at most two fit in a sequence) are matched greedily, each to
the longest partner that still fits; smaller ones go, longest first, to the
sequence with the smallest gap that holds them, or open a new one.

Defined results: a null text is empty and still has its end id; a document of
more than ``capacity`` ids is cut into pieces of ``capacity``; repeated rows
are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise
from riskloom.llm.tokens import encoder, text_chunks

ENCODED_CHARS = 500_000  # of text encoded at once: a fourth of the usual, for the pipeline's workers
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Slot:
    """``count`` pieces of ``length``, from rank ``rank`` on: ``each`` of them go to a
    sequence, the first to sequence ``sequence`` at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Slot]:
    """Place every piece of a histogram length -> number of pieces."""
    slots: list[Slot] = []
    used = dict.fromkeys(histogram, 0)
    left = dict(histogram)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number) with that gap
    order: list[int] = []                        # the gaps, ascending
    n_seq = 0

    def put(length: int, count: int, sequence: int, each: int, offset: int) -> None:
        slots.append(Slot(length, used[length], count, sequence, each, offset))
        used[length] += count
        left[length] -= count

    def free(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((sequence, count))

    large = sorted(x for x in histogram if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect.bisect_right(large, min(capacity - a, a)) - 1
            while i >= 0 and not left[large[i]]:
                i -= 1
            b = large[i] if i >= 0 else None
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            if b == a and not n:  # the odd one of its length looks for a shorter partner
                i -= 1
                while i >= 0 and not left[large[i]]:
                    i -= 1
                b, n = (large[i] if i >= 0 else None), 1
            put(a, n, n_seq, 1, 0)
            if b is not None:
                put(b, n, n_seq, 1, a)
            free(capacity - a - (b or 0), n_seq, n)
            n_seq += n
    for a in sorted((x for x in histogram if 3 * x <= capacity), reverse=True):
        while left[a]:
            at = bisect.bisect_left(order, a)
            if at < len(order):
                gap = order[at]
                seq, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, n = capacity, -(-left[a] // (capacity // a))
                seq = n_seq
                n_seq += n
            each = gap // a
            full = min(n, left[a] // each)
            if full:
                put(a, full * each, seq, each, capacity - gap)
                free(gap - each * a, seq, full)
            if full < n and (rest := left[a]) and rest < each:
                put(a, rest, seq + full, rest, capacity - gap)
                free(gap - rest * a, seq + full, 1)
                full += 1
            free(gap, seq + full, n - full)
    return slots


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text with its end id."""

    def encode(batches):
        enc = encoder(path)
        for part, texts in text_chunks(batches, limit=ENCODED_CHARS):
            ids, off = enc.encode(texts)
            rows = []
            for d, a, b in zip(part.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    x = own[s:s + capacity]
                    rows.append((d, k, s, len(x), zlib.crc32(x.tobytes())))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) with sequence_id and offset.

    Ranks: within (task, length) by a window, plus the sizes of the tasks before;
    no length, however common, is brought together in one task.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces.withColumn("_task", F.spark_partition_id()))
    sizes = materialise(pieces.groupBy("_task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("_task", "length").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("_r", within).join(sizes, ["_task", "length"]).withColumn("_rank", F.col("_r") + F.col("before")).drop("_r", "before")
    # the slots: a few for each of at most `capacity` lengths, in order of (length, rank)
    table = np.array([(s.length, s.rank, s.sequence, s.each, s.offset) for s in
                      sorted(slots, key=lambda s: (s.length, s.rank))] or np.zeros((0, 5)), np.int64)
    shared = spark.sparkContext.broadcast(table)
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.drop("_task").schema) + ", sequence_id long, offset long"
    names = pieces.drop("_task").columns

    def place(batches):
        t = shared.value
        span = np.int64(1) << 44
        keys = t[:, 0] * span + t[:, 1]
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c))
            length, rank = get("length").to_numpy(zero_copy_only=False), get("_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, length * span + rank, side="right") - 1
            j = rank - t[i, 1]
            yield pa.RecordBatch.from_arrays(
                [get(c) for c in names] + [pa.array(t[i, 2] + j // t[i, 3]), pa.array(t[i, 4] + j % t[i, 3] * length)],
                [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, out_schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
