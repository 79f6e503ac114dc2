"""Token-id files compressed by a Re-Pair grammar.

Texts are encoded, dealt out by ranges of ``doc_id`` and written in that order
as shards.  Inside a shard the most frequent pairs of ids are replaced by
nonterminals, round by round; a round takes many frequent pairs at once, each
place greedily from the left.  A shard stores its rules, the length to which
each rule expands, the remaining symbols and an index of its documents, so any
range of ids can be decoded without the rest of the shard.

File format: Parquet rows (part, block, n_ids, n_terminals, rules, lengths,
symbols, doc_ids, doc_starts); ``rules``, ``lengths``, ``symbols`` are
little-endian unsigned 32-bit numbers.  Symbol ``n_terminals + r`` is rule ``r``.

Defined results: null and empty texts hold the end id alone; repeated rows are
written once each, side by side; rows without a doc_id come first; an empty
table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.tokens import encoder, text_chunks
from riskloom.session import ensure_checkpoint_dir

SHARD_IDS = 1 << 20  # a shard closes after the document that brings it to so many ids
PAIRS = 8192         # pairs replaced in one round; the rounds go on until none is left
MIN_COUNT = 12       # a rule takes three numbers, so a pair must come back often enough
_BITS = 18

SHARD = ("part int, block int, n_ids long, n_terminals int, rules binary, lengths binary, symbols binary, "
         "doc_ids array<long>, doc_starts array<long>")


def _hash(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    odd = np.uint32((0x9E3779B1 + 0x3C6EF372 * turn) & 0xFFFFFFFF)
    return ((a * odd) ^ (b * np.uint32(0x85EBCA77) + (b >> np.uint32(7)))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - _BITS)


def _by_cells(seq: np.ndarray, pairs: int, min_count: int, turn: int):
    """Up to ``pairs`` frequent pairs, by a table of hash cells that fits the cache: (first, second,
    places, number of the pair at each place).  A cell stands for the first pair that fell into it;
    the cells differ from turn to turn, so a pair behind another one has its turn later."""
    h = _hash(seq[:-1], seq[1:], turn).astype(np.intp)
    counts = np.bincount(h, minlength=1 << _BITS)
    k = min(pairs, int((counts >= min_count).sum()))
    if not k:
        return None
    top = np.argpartition(counts, -k)[-k:]
    rank = np.full(1 << _BITS, -1, np.int32)
    rank[top] = np.arange(k)
    at = np.flatnonzero(rank[h] >= 0)
    r = rank[h[at]]
    rep = np.empty(k, np.int64)
    rep[r[::-1]] = at[::-1]
    a, b = seq[rep], seq[rep + 1]
    same = (seq[at] == a[r]) & (seq[at + 1] == b[r])
    return a, b, at[same], r[same]


def _by_count(seq: np.ndarray, pairs: int, min_count: int):
    """The same with exact counts of all pairs (those in cells that reach the minimum; no other pair can)."""
    h = _hash(seq[:-1], seq[1:], 0).astype(np.intp)
    may = np.flatnonzero((np.bincount(h, minlength=1 << _BITS) >= min_count)[h])
    if not len(may):
        return None
    key = seq[may].astype(np.uint64) << np.uint64(32) | seq[may + 1]
    order = np.argsort(key)  # places of one pair side by side
    starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    counts = np.diff(np.append(starts, len(key)))
    order = may[order]
    often = np.flatnonzero(counts >= min_count)
    often = often[np.argsort(-counts[often], kind="stable")[:pairs]]
    if not len(often):
        return None
    lens = counts[often]
    at = order[np.repeat(starts[often] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
    r = np.repeat(np.arange(len(often)), lens)
    left = np.argsort(at, kind="stable")
    rep = order[starts[often]]
    return seq[rep], seq[rep + 1], at[left], r[left]


def _apart(at: np.ndarray, r: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of places that overlap each other every second one from the left; before that, if asked for,
    those of the more frequent pair (the smaller number), so the most frequent one keeps all its own."""
    if len(at) > 1 and first:
        touch = np.diff(at) == 1
        keep = np.ones(len(at), bool)
        keep[1:] &= ~(touch & (r[:-1] < r[1:]))
        keep[:-1] &= ~(touch & (r[1:] < r[:-1]))
        at, r = at[keep], r[keep]
    if len(at) > 1 and (touch := np.diff(at) == 1).any():
        run = np.concatenate([[True], ~touch])
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - start) % 2 == 0
        at, r = at[keep], r[keep]
    return at, r


def compress(ids: np.ndarray, n_terminals: int, pairs: int = PAIRS, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules of shape (r, 2), expansion length of each rule, remaining symbols).

    Goes on until no pair can be replaced ``min_count`` times: by cells as long as that
    finds enough, then by exact counts."""
    seq = np.ascontiguousarray(ids, np.uint32)
    rules: list[np.ndarray] = []
    sizes = np.ones(n_terminals, np.uint32)
    turn, exact, most = 0, False, pairs
    while len(seq) > 1:
        found = _by_count(seq, most, min_count) if exact else _by_cells(seq, pairs, min_count, turn)
        new, n = np.zeros((0, 2), np.uint32), 0
        if found:
            a, b, at, r = found
            at, r = _apart(at, r, first=exact)
            good = np.bincount(r, minlength=len(a)) >= min_count
            symbol = np.cumsum(good) - 1 + n_terminals + sum(map(len, rules))
            at, r = at[good[r]], r[good[r]]
            new, n = np.stack([a[good], b[good]], axis=1), len(at)
        if n:
            stay = np.ones(len(seq), bool)
            stay[at + 1] = False
            seq = seq.copy() if seq is ids else seq
            seq[at] = symbol[r]
            seq = seq[stay]
            rules.append(new)
            sizes = np.concatenate([sizes, sizes[new[:, 0]] + sizes[new[:, 1]]])
        elif exact and found and most > 1:
            most = 1  # the most frequent pair overlaps itself: one at a time
        elif exact:
            break
        # cells find the last pairs slowly; exact counts take them all
        exact = exact or n <= len(seq) >> 5
        turn += 1
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return table, sizes[n_terminals:], seq


def expand(symbols: np.ndarray, rules: np.ndarray, n_terminals: int) -> np.ndarray:
    """The ids behind ``symbols``."""
    seq = np.asarray(symbols, np.uint32)
    while True:
        big = seq >= n_terminals
        if not big.any():
            return seq
        out = np.repeat(seq, 1 + big)
        at = np.flatnonzero(big)
        at = at + np.arange(len(at))
        pair = rules[seq[big] - np.uint32(n_terminals)]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        seq = out


def decode_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, n_terminals: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a shard: only the symbols that cover them are expanded."""
    size = np.ones(len(symbols), np.int64)
    big = symbols >= n_terminals
    size[big] = lengths[symbols[big] - np.uint32(n_terminals)]
    ends = np.cumsum(size)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left") + 1
    first = ends[a] - size[a] if a < len(ends) else 0
    return expand(symbols[a:b], rules, n_terminals)[start - first:end - first]


def write(docs: DataFrame, path: str, out: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all texts, in ascending order of doc_id, as shards under ``out``."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        n_terminals = max(enc.tok.get_vocab_size(), end_id + 1)
        held, docs_, starts, n = [], [], [], 0

        def shard():
            rules, lengths, symbols = compress(np.concatenate(held), n_terminals)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()), pa.array([n_terminals], pa.int32()),
                 *[pa.array([np.ascontiguousarray(x, "<u4").tobytes()], pa.binary()) for x in (rules, lengths, symbols)],
                 pa.array([docs_], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64()))],
                [x.split()[0] for x in SHARD.split(", ")])

        for chunk, texts in text_chunks(batches):
            ids, off = enc.encode(texts)
            # the end id goes behind each document
            own = np.insert(ids, off[1:], np.uint32(end_id))
            cuts = (off + np.arange(len(off))).tolist()
            names = chunk.column(0).to_pylist()
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and n + cuts[end] - cuts[at] < shard_ids:
                    end += 1
                held.append(own[cuts[at]:cuts[end]])
                docs_ += names[at:end]
                starts += [n + c - cuts[at] for c in cuts[at:end]]
                n += cuts[end] - cuts[at]
                at = end
                if n >= shard_ids:
                    yield shard()
                    held, docs_, starts, n, block = [], [], [], 0, block + 1
        if held:
            yield shard()

    ordered.mapInArrow(run, SHARD).write.parquet(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards under ``path``: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    # ids before each shard: sums by part, then blocks within the part
    heads = shards.select("part", "block", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("p0"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("b0")).join(parts, "part")
    bases = heads.select("part", "block", (F.col("p0") + F.col("b0")).alias("base"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                num = {k: np.frombuffer(row[k], "<u4") for k in ("rules", "lengths", "symbols")}
                ids = expand(num["symbols"], num["rules"].reshape(-1, 2), row["n_terminals"]).astype("<u4")
                data = memoryview(ids.tobytes())
                cuts = [*row["doc_starts"], len(ids)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * (len(cuts) - 1), pa.int32()), pa.array([row["block"]] * (len(cuts) - 1), pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(cuts[:-1], pa.int64()), pa.array(np.diff(cuts), pa.int64()),
                     pa.array([zlib.crc32(data[4 * x:4 * y]) for x, y in zip(cuts[:-1], cuts[1:])], pa.int64())],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = shards.mapInArrow(run, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["part", "block"]).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    out = f"{ensure_checkpoint_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, out, end_id)
    return read(docs.sparkSession, out)
