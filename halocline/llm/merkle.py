"""Merkle manifest of a table: one hash tree for each partition value, and one over their roots.

A fragment is a sparse forest: nodes whose parents aren't known yet, keyed by tree,
level and run of siblings. Adding a node to a run, or the nodes of another fragment,
in any order gives the same forest: as soon as a run has as many nodes as the size of
its tree says, it becomes its parent, which is added in turn. Merging fragments is so
associative and commutative, and the empty forest is its unit.

Leaves are numbered within their tree (positions in a range-partitioned sort, plus
what the ranges before hold), sorted, and each partition folds its own leaves as a
stream: what stays open are the few runs at its two ends. Fragments are then merged
in a tree reduction, FAN_IN at a time, until one is left. Its rounds are tables in
the shared folder and not RDD.treeReduce, whose last merges run in the driver: every
merge is a bounded group, a lost executor repeats its own merges only, and complete
runs leave as rows, which is where proofs find their siblings. The driver sees counts.

The path of a leaf has, for each level up to the root, what its siblings to the left
and to the right hash to, as text. Paths are handed down from the root a level at a
time: a join of runs with the paths of their parents, each a fraction of the next.

Null is a value of its own everywhere (as a partition it comes first). Leaves of
equal order are ordered by digest; equal rows are equal leaves. A tree of one leaf is
that leaf. An empty table has no rows and no root. Long texts are hashed whole, once.
Users' columns travel in a struct. Numbers of trees and leaves may grow at will; a
path has the siblings of a few levels only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ARITY = 8
#: Fragments that a merge takes in.
FAN_IN = 16
#: Leaves of a partition, about.
PART_LEAVES = 20_000
MOST_PARTS = 50_000

OPEN, RUN, ROOT = 0, 1, 2
_FRAGMENT = "part long, kind int, level int, tree string, size long, run long, slots array<int>, members array<string>"
_NAMES = [x.split()[0] for x in _FRAGMENT.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]


def digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns' values, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]), 256)


def height(size: int, arity: int = ARITY) -> int:
    """Levels above the leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // arity), n + 1
    return n


class Forest:
    """A sparse forest; ``rows`` takes what is complete: runs with all their members, and roots."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: dict[tuple[str, int, int, int], dict[int, str]] = {}
        self.rows: list[tuple] = []

    def add(self, tree: str, size: int, level: int, index: int, value: str) -> None:
        arity = self.arity
        width = size
        for _ in range(level):
            width = -(-width // arity)
        while width > 1:
            run, slot = divmod(index, arity)
            key = (tree, size, level, run)
            own = self.open.setdefault(key, {})
            own[slot] = value
            if len(own) < min(arity, width - run * arity):
                return
            del self.open[key]
            members = [own[k] for k in range(len(own))]
            self.rows.append((RUN, level, tree, size, run, None, members))
            value = sha256("".join(members).encode()).hexdigest()
            level, index, width = level + 1, run, -(-width // arity)
        self.rows.append((ROOT, level, tree, size, 0, None, [value]))

    def merge(self, other: Iterator[tuple[str, int, int, int, list[int], list[str]]]) -> None:
        """Add the open runs of another fragment: tree, size, level, run, slots and members."""
        for tree, size, level, run, slots, members in other:
            for slot, value in zip(slots, members):
                self.add(tree, size, level, run * self.arity + slot, value)

    def taken(self, part: int, last: bool = False) -> pa.RecordBatch:
        """What is complete so far, and in the end what is open; it leaves the forest."""
        rows = self.rows
        if last:
            rows = rows + [(OPEN, level, tree, size, run, list(own), list(own.values())) for (tree, size, level, run), own in self.open.items()]
        self.rows = []
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.record_batch([pa.array(x, t) for x, t in zip([[part] * len(rows), *columns], _TYPES)], _NAMES)


def _fold(arity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, forest = TaskContext.get().partitionId(), Forest(arity)
        for batch in batches:
            for tree, size, index, leaf in zip(*(batch.column(c).to_pylist() for c in ("_tree", "_size", "_index", "leaf"))):
                forest.add(tree, size, 0, index, leaf)
            yield forest.taken(part)
        yield forest.taken(part, last=True)

    return run


def _merge(arity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest(arity)
        forest.merge(zip(*(table.column(c).to_pylist() for c in ("tree", "size", "level", "run", "slots", "members"))))
        return pa.Table.from_batches([forest.taken(key[0].as_py(), last=True)])

    return run


def _parts(leaves: int) -> int:
    return max(1, min(MOST_PARTS, -(-leaves // PART_LEAVES)))


def _numbered(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` (_row, _tree, _order, leaf) with _index, the position in the tree by _order and leaf, and _size of the tree."""
    key = ["_tree", "_order", "leaf"]
    low = (1 << 33) - 1
    at = F.monotonically_increasing_id()
    # Written before it is counted: a second sort could cut the ranges elsewhere.
    placed = materialise(rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(low)), "merkle-sorted")
    held = placed.groupBy("_tree", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("lo"))
    whole = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("_tree", "_part", (before - F.col("lo")).alias("_shift"), F.sum("n").over(whole).alias("_size"))
    return placed.join(held, ["_tree", "_part"]).withColumn("_index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", "_order")


def _forest(numbered: DataFrame, parts: int, arity: int) -> DataFrame:
    """All complete runs and roots."""
    key = ["_tree", "_index"]
    leaves = numbered.select("_tree", "_size", "_index", "leaf").repartitionByRange(parts, *key).sortWithinPartitions(*key)
    last = materialise(leaves.mapInArrow(_fold(arity), _FRAGMENT), "merkle-0", "kind", "level")
    every = last.where(F.col("kind") != OPEN)
    left = last.where(F.col("kind") == OPEN).agg(F.max("part")).first()[0]
    while left is not None:
        merged = last.where(F.col("kind") == OPEN).withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(_merge(arity), _FRAGMENT)
        last = materialise(merged, "merkle-merged", "kind", "level")
        every = every.unionByName(last.where(F.col("kind") != OPEN))
        if left == 0 and last.where(F.col("kind") == OPEN).take(1):
            raise ValueError("a tree has fewer leaves than its size says")
        left = last.where(F.col("kind") == OPEN).agg(F.max("part")).first()[0]
    return every


_STEP = "array<struct<left:string,right:string>>"


def _descend(forest: DataFrame, top: DataFrame, levels: int, arity: int) -> DataFrame:
    """(tree, run, members, subroot, root, path): for each run of leaves the path of its parent; members is null for a tree of one leaf.

    ``top`` has tree, size, subroot, root and the path of the subroot.
    """
    heights = F.lit(0)
    for k in range(levels):
        heights = heights + (F.col("size") > arity**k).cast("int")
    top = top.withColumn("height", heights)
    kept = ["subroot", "root", "path"]
    roots = lambda k: top.where(F.col("height") == k).select("tree", F.lit(0).cast("long").alias("index"), *kept)
    nodes = roots(levels)
    for k in range(levels - 1, -1, -1):
        runs = forest.where((F.col("kind") == RUN) & (F.col("level") == k)).select("tree", "run", "members")
        nodes = nodes.withColumnRenamed("index", "run").join(runs, ["tree", "run"])
        if not k:
            break
        nodes = nodes.select("tree", "run", *kept, "members", F.posexplode("members").alias("slot", "own"))
        step = F.array(_step(F.col("members"), F.col("slot")))
        nodes = nodes.select("tree", (F.col("run") * arity + F.col("slot")).alias("index"), "subroot", "root", F.concat(step, F.col("path")).alias("path")).unionByName(roots(k))
    lone = roots(0).select("tree", F.col("index").alias("run"), F.lit(None).cast("array<string>").alias("members"), *kept)
    return nodes.select("tree", "run", "members", *kept).unionByName(lone) if levels else lone


def _step(members: Column, slot: Column) -> Column:
    """What the siblings of a slot hash to, on its left and right."""
    side = lambda start, n: F.array_join(F.slice(members, start, n), "")
    return F.struct(side(F.lit(1), slot).alias("left"), side(slot + 2, F.size(members)).alias("right"))


def _with_paths(rows: DataFrame, arity: int, top_of=None) -> DataFrame:
    """``rows`` (_row, _tree, _order, leaf), written, with subroot, root and path; ``top_of`` makes these three for the roots of the trees, else a tree's root is the root."""
    parts = _parts(rows.count())
    numbered = _numbered(rows, parts)
    forest = _forest(numbered, parts, arity)
    roots = forest.where(F.col("kind") == ROOT).select("tree", "size", F.col("members")[0].alias("subroot"))
    largest = roots.agg(F.max("size")).first()[0] or 0
    top = top_of(roots) if top_of else roots.select("*", F.col("subroot").alias("root"), F.array().cast(_STEP).alias("path"))
    level = _descend(forest, top, height(largest, arity), arity).withColumnsRenamed({"tree": "_tree", "run": "_run"})
    out = numbered.withColumn("_run", F.floor(F.col("_index") / arity)).join(level, ["_tree", "_run"])
    own = F.when(F.col("members").isNull(), F.col("path")).otherwise(F.concat(F.array(_step(F.col("members"), (F.col("_index") % arity).cast("int"))), F.col("path")))
    return out.select("_row", "leaf", "subroot", "root", own.alias("path"))


def manifest(rows: DataFrame, partition: Column, order: Column, leaf: Column, arity: int = ARITY) -> DataFrame:
    """The columns of ``rows`` in a struct ``_row`` beside leaf, subroot (of the partition's tree), root (of all) and path.

    ``rows`` should have few columns beside those of ``leaf``: they are written once, sorted once and joined once.
    """
    # Null comes before all texts, and the empty text is no null.
    tree = F.coalesce(F.concat(F.lit("="), partition.cast("string")), F.lit(""))
    own = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("_row"), tree.alias("_tree"), order.alias("_order"), leaf.alias("leaf"))

    def top_of(roots: DataFrame) -> DataFrame:
        roots = materialise(roots.select(F.struct("tree", "size").alias("_row"), F.lit("").alias("_tree"), F.col("tree").alias("_order"), F.col("subroot").alias("leaf")), "merkle-roots")
        return _with_paths(roots, arity).select("_row.tree", "_row.size", F.col("leaf").alias("subroot"), "root", "path")

    return _with_paths(materialise(own, "merkle-leaves"), arity, top_of)


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))
