"""A lexicon of frequent pieces as a minimal acyclic transducer.

``compile_lexicon`` builds the minimal deterministic acyclic automaton of a
sorted list of byte strings (equal endings share their states).  Every edge
carries the number of accepted strings that sort before those behind it, so the
sum along a path is the string's place in the list, and the place leads to its
ids.  All arrays go into one file of 32-bit integers, which ``Lexicon`` memory
maps; ``lookup`` walks all asked pieces at once, one byte at a time.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialise
from riskloom.llm.tokens import Encoder, text_chunks

MAGIC = 0x4C58


def compile_lexicon(words: dict[bytes, list[int]], path: str) -> None:
    """Write the transducer of ``words`` -> ids to the file ``path``."""
    order = sorted(words)
    final: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    open_path: list[int] = [0]  # states of the word read last, from the root
    last = b""

    def close(depth: int) -> None:
        """Replace the open states below ``depth`` by equal ones that are there already."""
        while len(open_path) > depth + 1:
            s = open_path.pop()
            parent, label = open_path[-1], last[len(open_path) - 1]
            edges[parent][label] = register.setdefault((final[s], tuple(edges[s].items())), s)

    for w in order:
        k = 0
        while k < min(len(w), len(last)) and w[k] == last[k]:
            k += 1
        close(k)
        last = w
        for c in w[k:]:
            final.append(False)
            edges.append({})
            edges[open_path[-1]][c] = len(final) - 1
            open_path.append(len(final) - 1)
        final[open_path[-1]] = True
    close(0)
    # number the states that are left, and count the words behind each
    number: dict[int, int] = {0: 0}
    stack, after = [0], []
    while stack:
        s = stack.pop()
        after.append(s)
        for t in edges[s].values():
            if t not in number:
                number[t] = len(number)
                stack.append(t)
    behind: dict[int, int] = {}
    todo = [0]
    while todo:
        s = todo[-1]
        rest = [t for t in edges[s].values() if t not in behind]
        if rest:
            todo += rest
        else:
            behind[s] = final[s] + sum(behind[t] for t in edges[s].values())
            todo.pop()
    rows = []
    for s in after:
        skipped = int(final[s])
        for c, t in sorted(edges[s].items()):
            rows.append((number[s] * 256 + c, number[t], skipped))
            skipped += behind[t]
    rows.sort()
    table = np.array(rows or np.zeros((0, 3)), np.int32)
    ends = np.zeros(len(number), np.int32)
    ends[[number[s] for s in number if final[s]]] = 1
    ids = [words[w] for w in order]
    offs = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.array([i for x in ids for i in x], np.int32)
    parts = [table[:, 0], table[:, 1], table[:, 2], ends, offs, flat]
    head = np.array([MAGIC, *map(len, parts)], np.int32)
    with open(path, "wb") as f:
        for p in (head, *parts):
            f.write(np.ascontiguousarray(p, "<i4").tobytes())


class Lexicon:
    """The memory-mapped transducer."""

    def __init__(self, path: str):
        data = np.memmap(path, "<i4", mode="r")
        if data[0] != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        cuts = 7 + np.concatenate([[0], np.cumsum(data[1:7])])
        self.keys, self.to, self.skip, self.ends, self.offs, self.flat = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))

    def lookup(self, pieces: list[str]) -> list[list[int] | None]:
        """Ids of each piece, None for a piece that isn't in the lexicon."""
        out: list[list[int] | None] = [None] * len(pieces)
        if not pieces or not len(self.keys):
            return out
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        text = np.frombuffer(b"".join(raw), np.uint8)
        begin = np.cumsum(lens) - lens
        state, place = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        live = np.flatnonzero(lens > 0)
        done = []
        step = 0
        while len(live):
            key = state[live] * 256 + text[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.to[at]
            place[live] += self.skip[at]
            step += 1
            over = lens[live] == step
            done.append(live[over])
            live = live[~over]
        for i in np.concatenate(done).tolist():
            if self.ends[state[i]]:
                p = place[i]
                out[i] = self.flat[self.offs[p]:self.offs[p + 1]].tolist()
        return out


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(piece, n): how often each distinct piece occurs in all texts."""
    import pyarrow as pa

    def count(batches):
        enc = Encoder(path)
        for _, texts in text_chunks(batches):
            distinct, piece, codes, _ = enc.pieces(texts)
            n = np.bincount(codes, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array([piece(i) for i in range(len(distinct))], pa.string()), pa.array(n, pa.int64())], ["piece", "n"])

    return docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, path: str, size: int, longest: int = 64) -> list[str]:
    """The ``size`` most frequent pieces of all texts (a bounded list on the driver)."""
    top = piece_counts(docs, path).where((F.col("n") > 1) & (F.length("piece") <= longest)).orderBy(F.desc("n"), "piece").limit(size)
    # written first: else every task would send its own candidates to the driver
    return [r["piece"] for r in materialise(top.select("piece")).collect()]


def publish(spark: SparkSession, pieces: Iterable[str], path: str) -> str:
    """Compile the lexicon of ``pieces`` and hand the file to every executor; returns its name."""
    enc = Encoder(path)
    pieces = list(pieces)
    ids = [e.ids for e in enc.tok.encode_batch_fast(pieces, add_special_tokens=False)]
    fd, file = tempfile.mkstemp(prefix="lexicon-", suffix=".bin")
    os.close(fd)
    compile_lexicon({p.encode(): k for p, k in zip(pieces, ids)}, file)
    spark.sparkContext.addFile(os.path.realpath(file))
    return os.path.basename(file)
