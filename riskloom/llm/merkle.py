"""Merkle dataset manifest: a hash tree for each group of rows, proofs and their check.

The leaves of a group stand in ascending order of a key; every ``fan``
consecutive nodes become their hash until one, the subroot, remains; the
subroots in order of the group (null first) likewise give the root.

The trees are computed by time-forward processing.  Nodes are labelled in post
order (a node after its children).  A sweep visits labels in ascending order; a
priority queue ordered by label holds what children have sent to parents that
are still to come.  A tree is cut into slices of ``fan ** depth`` consecutive
nodes, so a task's queue holds at most ``fan * depth`` digests; what a slice
sends beyond itself, its top digest, is sorted to the next round's slices by
Spark, the external part of the queue.  Each round leaves one node of a slice,
so the rounds grow with the logarithm of the rows.  The reversed sweep visits
labels in descending order, round by round from the root; its queue hands every
node the proof suffix of its parent, before which the node's siblings are put.

A proof is an array of (left, right), from the leaf up: the digests of the
run's other nodes on both sides, concatenated.

Defined results: a null value enters its leaf as ``-``; rows without a key stand
first in their group; rows that repeat a key stand in order of their digests,
equal rows anywhere among themselves (they get the same set of proofs); a group
of one row has its leaf as subroot; an empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.llm.common import Scratch
from riskloom.llm.ranks import positions

PROOF = "array<struct<left:string,right:string>>"
_PROOF_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
ROOT_TREE = "root"


def leaf_digest(*values: Column) -> Column:
    """Hex SHA-256 of ``bytes:value`` of every value, ``-`` for a null."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda acc, p: F.sha2(F.concat(p.left, acc, p.right), 256))


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, leaf to root, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p.left, p.right)), "")


def _hash(kids: Iterable[str]) -> str:
    return hashlib.sha256("".join(kids).encode()).hexdigest()


class Slice:
    """The part of a tree over one slice's nodes, by a forward and a reversed sweep."""

    def __init__(self, digests: list[str], fan: int, depth: int):
        self.fan, self.n = fan, len(digests)
        self.kids: dict[tuple[int, int], list[str]] = {}  # label (last node, level) -> digests of the children
        self.tops: list[str] = []  # what the slice gives at each level at which it is one node
        self._forward(digests, depth)

    def _label(self, level: int, index: int) -> tuple[int, int]:
        return min((index + 1) * self.fan**level, self.n) - 1, level

    def _forward(self, digests: list[str], depth: int) -> None:
        queue: list[tuple[int, int, int, str]] = []  # receiver's label, child's index, digest

        def send(level: int, index: int, digest: str) -> None:
            if self.n <= self.fan**level:
                self.tops.append(digest)
            if level < depth:
                heapq.heappush(queue, (*self._label(level + 1, index // self.fan), index, digest))

        for at, digest in enumerate(digests):
            send(0, at, digest)
            while queue and queue[0][0] == at:
                label, index = queue[0][:2], queue[0][2]
                kids = []
                while queue and queue[0][:2] == label:
                    kids.append(heapq.heappop(queue)[3])
                self.kids[label] = kids
                send(label[1], index // self.fan, _hash(kids))

    def suffixes(self, levels: int, above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
        """The proof of every node: its siblings within ``levels`` levels, then ``above``."""
        out: list[list[tuple[str, str]]] = [above] * self.n
        queue: list[tuple[int, int, list[tuple[str, str]]]] = []  # negated label, suffix
        if levels:
            last, level = self._label(levels, 0)
            queue.append((-last, -level, above))
        while queue:
            last, level, suffix = heapq.heappop(queue)
            last, level = -last, -level
            kids, first = self.kids[last, level], last // self.fan**level * self.fan
            for k, _ in enumerate(kids):
                own = [("".join(kids[:k]), "".join(kids[k + 1:])), *suffix]
                if level == 1:
                    out[first + k] = own
                else:
                    below, step = self._label(level - 1, first + k)
                    heapq.heappush(queue, (-below, -step, own))
        return out


def _groups(batches, n_keys: int):
    """(key, rows) of consecutive rows whose first ``n_keys`` columns agree."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = r[:n_keys], []
            rows.append(r)
    if rows:
        yield key, rows


def _slices(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("slice", F.floor(F.col("pos") / size).cast("long"))


def _up(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """(tree, pos, digest) -> (tree, slice, lone, full): a slice's digest if it is all of its tree, and if not."""

    def run(batches):
        out: list[tuple] = []
        for (tree, piece), rows in _groups(batches, 2):
            s = Slice([r[3] for r in rows], fan, depth)
            out.append((tree, piece, s.tops[0], s.tops[-1]))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["tree", "slice", "lone", "full"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["tree", "slice", "lone", "full"])

    dealt = _slices(nodes.select("tree", "pos", "digest"), fan**depth).select("tree", "slice", "pos", "digest")
    return dealt.repartition("tree", "slice").sortWithinPartitions("tree", "slice", "pos").mapInArrow(
        run, "tree string, slice long, lone string, full string")


def _down(nodes: DataFrame, mail: DataFrame, fan: int, depth: int) -> DataFrame:
    """Every node of (tree, pos, digest, ...) with proof, subroot and root, from what ``mail``
    (tree, slice, lone, proof, subroot, root) holds for its slice."""
    names = nodes.columns
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema if f.name not in ("tree", "pos")]
    sent = mail.select("tree", "slice", F.lit(-1).cast("long").alias("pos"), *none, "lone", "proof", "subroot", "root")
    own = _slices(nodes, fan**depth).select(
        "tree", "slice", "pos", *[f.name for f in nodes.schema if f.name not in ("tree", "pos")], F.lit(None).cast("boolean").alias("lone"),
        F.lit(None).cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    columns = own.columns
    place = [columns.index(c) for c in names]
    digest, lone, proof, subroot, root = (columns.index(c) for c in ("digest", "lone", "proof", "subroot", "root"))
    types = [to_arrow_type(nodes.schema[c].dataType) for c in names]

    def run(batches):
        for _, rows in _groups(batches, 2):
            head, rows = rows[0], rows[1:]
            s = Slice([r[digest] for r in rows], fan, depth)
            levels = depth + 1 - len(s.tops) if head[lone] else depth
            proofs = s.suffixes(levels, [(p["left"], p["right"]) for p in head[proof]])
            ends = [0]
            for p in proofs:
                ends.append(ends[-1] + len(p))
            pairs = pa.StructArray.from_arrays([pa.array([x[i] for p in proofs for x in p], pa.string()) for i in (0, 1)], ["left", "right"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in zip(place, types)]
                + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(_PROOF_ARROW)]
                + [pa.array([head[i]] * len(rows), pa.string()) for i in (subroot, root)], [*names, "proof", "subroot", "root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + f", proof {PROOF}, subroot string, root string"
    return (own.unionByName(sent).repartition("tree", "slice").sortWithinPartitions("tree", "slice", "pos").mapInArrow(run, schema))


class Forest:
    """The hash trees over (tree, pos, digest, ...), one for each ``tree``."""

    def __init__(self, nodes: DataFrame, fan: int, depth: int, scratch: Scratch):
        self.fan, self.depth, self.scratch = fan, depth, scratch
        self.rounds: list[DataFrame] = []  # the nodes that entered each round
        self.ended: list[DataFrame] = []  # (tree, digest) of the trees that were one slice in it
        while True:
            self.rounds.append(nodes)
            tops = scratch.table(_up(nodes, fan, depth))
            last = tops.groupBy("tree").agg(F.max("slice").alias("last"))
            self.ended.append(tops.join(last.where("last = 0"), "tree", "left_semi").select("tree", F.col("lone").alias("digest")))
            nodes = tops.join(last.where("last > 0"), "tree", "left_semi").select("tree", F.col("slice").alias("pos"), F.col("full").alias("digest"))
            if nodes.isEmpty():
                break

    def tops(self) -> DataFrame:
        """(tree, digest): the last node of every tree."""
        out = self.ended[0]
        for e in self.ended[1:]:
            out = out.union(e)
        return out

    def proofs(self, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The first round's nodes with proof, subroot and root; ``above`` gives (tree, proof,
        subroot, root) for (tree, digest) of ended trees."""
        mail = None
        for r in reversed(range(len(self.rounds))):
            own = above(self.ended[r]).select("tree", F.lit(0).cast("long").alias("slice"), F.lit(True).alias("lone"), "proof", "subroot", "root")
            mail = own if mail is None else own.unionByName(mail)
            found = _down(self.rounds[r], mail, self.fan, self.depth)
            if r:
                mail = self.scratch.table(found).select("tree", F.col("pos").alias("slice"), F.lit(False).alias("lone"), "proof", "subroot", "root")
        return found


def manifest(rows: DataFrame, group: Column, key: Column, leaf: Column, carry: dict[str, Column] | None = None,
             fan: int = 8, depth: int = 3) -> DataFrame:
    """key, leaf, subroot, root, proof of every row, and the columns of ``carry``.

    The text is read once, for the digests; what is sorted and sent are a key, a
    digest and the carried columns.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    carry = carry or {}
    held = {f"c{i}": c for i, c in enumerate(carry.values())}
    # sorts null first and else as the bytes of the group, and is never null
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    leaves = scratch.table(rows.select(tree.alias("tree"), key.alias("key"), leaf.alias("digest"), *[c.alias(n) for n, c in held.items()]))
    placed = scratch.table(positions(leaves, ["tree"], ["key", "digest"], scratch))
    forest = Forest(placed, fan, depth, scratch)
    # the tree over the subroots
    subroots = scratch.table(forest.tops().select(F.lit(ROOT_TREE).alias("tree"), F.col("tree").alias("name"), "digest"))
    subroots = scratch.table(positions(subroots, ["tree"], ["name"], scratch))
    over = Forest(subroots, fan, depth, scratch)
    roots = scratch.table(over.proofs(lambda ended: ended.select(
        "tree", F.array().cast(PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))))
    roots = roots.select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    found = forest.proofs(lambda ended: ended.select("tree").join(roots, "tree"))
    return found.select("key", F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(n).alias(c) for n, c in zip(held, carry)])
