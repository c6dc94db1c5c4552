"""Merkle dataset manifest: digests, authentication paths and their verification, distributed.

Rows become leaves; the leaves of a tree, in their order, are numbered across range partitions. Aligned blocks of ``2**DEPTH``
leaves are packed as one row each, and their roots are the leaves of the next stage, so a tree of n leaves takes log(n) / DEPTH stages, each
a table that many times smaller. The subroots of all trees are the leaves of one more tree. Paths are then made from
the top down: a block gets the path of its root, and a fractal traversal (Jakobsson, Leighton, Micali and Szydlo,
"Fractal Merkle Tree Representation and Traversal") emits the path of leaf after leaf: per level of stacked subtrees one that exists
and one that is being built for the leaves to come, some nodes a leaf, so a block never holds its whole tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import materialise, tidied

#: Levels of a block, and of each of the subtrees stacked in it.
DEPTH, HEIGHT = 10, 5
#: Up to so many starts of ranges are broadcast.
FEW = 300_000
_LEFT, _RIGHT, _NONE = b"l", b"r", b"-"


def digest(*parts: bytes) -> bytes:
    """H of hexadecimal digests as text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(value: Column) -> Column:
    """A field of a leaf: its UTF-8 byte count, a colon and the value; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


class _Build:
    """A subtree in the making: ``step`` takes one leaf or makes one node of it, on a stack of one node a level."""

    def __init__(self, traversal: Fractal, level: int, place: int):
        self.of, self.low = traversal, level * traversal.height
        self.top = min(self.low + traversal.height, traversal.depth)
        self.next, self.end = place << self.top, min((place + 1) << self.top, len(traversal.leaves))
        self.stack: list[tuple[int, int, bytes]] = []
        #: (level, place) -> node, of the subtree's own levels under its root
        self.nodes: dict[tuple[int, int], bytes] = {}

    def step(self) -> bool:
        """False once the root is there."""
        stack = self.stack
        if stack and stack[-1][0] == self.top:
            return False
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, _, right), (_, place, left) = stack.pop(), stack.pop()
            self._push(level + 1, place >> 1, self.of.hash(left, right))
        elif self.next < self.end:
            self._push(0, self.next, self.of.leaves[self.next])
            self.next += 1
        else:  # the last node of its level has no partner
            level, place, lone = stack.pop()
            self._push(level + 1, place >> 1, self.of.hash(lone))
        return True

    def _push(self, level: int, place: int, node: bytes) -> None:
        self.stack.append((level, place, node))
        if self.low <= level < self.top:
            self.nodes[level, place] = node

    def finish(self) -> None:
        while self.step():
            pass


class Fractal:
    """Authentication paths of a block's leaves, one after the other.

    leaves: hexadecimal digests; depth: levels up to the block's root. At each level of subtrees two are held, the one that
    the present leaf lies in and the next, which each leaf brings forward by two steps: as many as its leaves and nodes need before it is used.
    """

    def __init__(self, leaves: list[bytes], depth: int, height: int = HEIGHT):
        self.leaves, self.depth, self.height, self.hashed, self.most_held = leaves, depth, height, 0, 0
        self.levels = -(-depth // height)

    def hash(self, *parts: bytes) -> bytes:
        self.hashed += 1
        return digest(*parts)

    def root(self) -> bytes:
        if not self.depth:
            return self.leaves[0]
        whole = _Build(self, 0, 0)
        whole.top, whole.end, whole.low = self.depth, len(self.leaves), self.depth
        whole.finish()
        return whole.stack[0][2]

    def paths(self) -> Iterator[tuple[bytes, bytes]]:
        """Of each leaf: for each level, where the sibling stands (l, r, or - for none), and the siblings' digests in a row."""
        n, widths = len(self.leaves), [min((k + 1) * self.height, self.depth) for k in range(self.levels)]
        exist = [_Build(self, k, 0) for k in range(self.levels)]
        for tree in exist:
            tree.finish()
        desired = [_Build(self, k, 1) if 1 << widths[k] < n else None for k in range(self.levels)]
        for at in range(n):
            for k, width in enumerate(widths):
                if at and not at & ((1 << width) - 1):
                    desired[k].finish()
                    exist[k], place = desired[k], (at >> width) + 1
                    desired[k] = _Build(self, k, place) if place << width < n else None
                elif (tree := desired[k]) is not None:
                    tree.step()
                    tree.step()
            sides, siblings = [], []
            for level in range(self.depth):
                place = at >> level
                other = exist[level // self.height].nodes.get((level, place ^ 1))
                sides.append(_NONE if other is None else _LEFT if place & 1 else _RIGHT)
                if other is not None:
                    siblings.append(other)
            self.most_held = max(self.most_held, sum(len(t.nodes) + len(t.stack) for t in [*exist, *desired] if t is not None))
            yield b"".join(sides), b"".join(siblings)


def fold(leaf: bytes, sides: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    at, node = 0, leaf
    for side in sides:
        if side == _NONE[0]:
            node = digest(node)
            continue
        other = siblings[at : at + 64]
        at += 64
        node = digest(other, node) if side == _LEFT[0] else digest(node, other)
    return node


def depth_of(n: int, most: int) -> int:
    """Levels from a block's leaves to its root, in a tree of ``n`` at this stage."""
    return most if n > 1 << most else max(0, n - 1).bit_length()


def numbered(leaves: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``idx``, the leaf's place in its ``tree``, and ``n``, the tree's leaves. No tree is ever gathered: ranges number their own rows."""
    tie = leaves.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange("tree", *order, "__tie").sortWithinPartitions("tree", *order, "__tie").drop("__tie")
    kept = materialise(ranged.withColumn("__pos", F.monotonically_increasing_id()), label).withColumn("__range", F.shiftright("__pos", 33))
    tree = Window.partitionBy("tree")
    starts = kept.groupBy("tree", "__range").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__k"))
    starts = starts.withColumn("__before", F.coalesce(F.sum("__k").over(tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = materialise(starts.withColumn("n", F.sum("__k").over(tree)).drop("__k"), f"{label}-starts")
    few = starts.count() <= FEW
    place = F.col("__pos") - F.col("__first") + F.col("__before")
    return kept.join(F.broadcast(starts) if few else starts, ["tree", "__range"]).withColumn("idx", place).drop("__pos", "__range", "__first", "__before")


def packed(nodes: DataFrame, label: str, depth: int) -> DataFrame:
    """One row a block: (tree, n, block, leaves), leaves an array of structs that begin with idx, in its order. At most ``2**depth`` each."""
    own = [c for c in nodes.columns if c not in ("tree", "n", "idx")]
    blocks = nodes.groupBy("tree", "n", F.shiftright("idx", depth).alias("block"))
    return materialise(blocks.agg(F.sort_array(F.collect_list(F.struct("idx", *own))).alias("leaves")), label)


def _hex(digests: pa.Array) -> list[bytes]:
    return [d.hex().encode() for d in digests.to_pylist()]


def _roots(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Input: blocks; output: the same stage's roots, which are the next stage's leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Fractal(_hex(of.values.field("leaf")), depth_of(n.as_py(), depth)).root() for n, of in zip(batch.column(1), batch.column(3), strict=True)]
            n = [-(-k // (1 << depth)) for k in batch.column(1).to_pylist()]
            roots = pa.array([bytes.fromhex(m.decode()) for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(2), roots], ["tree", "n", "idx", "leaf"])

    return run


def _raw(siblings: bytes) -> bytes:
    return bytes.fromhex(siblings.decode())


def _lower_paths(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Input: blocks with their roots' paths (sides, siblings, tag); output: each node's path to the top, and the same tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tree, n, of = (batch.column(c)[k] for c in (0, 1, 3))
                sides, siblings, tag = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                paths = [(s + sides, _raw(d) + siblings) for s, d in Fractal(_hex(of.values.field("leaf")), depth_of(n.as_py(), depth)).paths()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree.as_py()] * len(paths), pa.binary()), of.values.field("idx"), *[pa.array(c, pa.binary()) for c in zip(*paths, strict=True)], pa.array([tag] * len(paths), pa.binary())],
                    ["tree", "block", "sides", "siblings", "tag"],
                )

    return run


def _leaf_rows(depth: int, root: bytes, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Input: blocks of rows with their paths; output: each row's digests and its verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, of = batch.column(1)[k], batch.column(3)[k]
                sides, siblings, subroot = batch.column(4)[k].as_py(), batch.column(5)[k].as_py().hex().encode(), batch.column(6)[k].as_py()
                leaves, rows = _hex(of.values.field("leaf")), []
                for leaf, now, (s, d) in zip(leaves, of.values.field("found").to_pylist(), Fractal(leaves, depth_of(n.as_py(), depth)).paths(), strict=True):
                    folded = fold(now.hex().encode() if now else leaf, s + sides, d + siblings)
                    rows.append((leaf.decode(), subroot.hex(), root.decode(), hashlib.sha256(d + siblings).hexdigest(), folded.decode(), folded == root))
                columns = [pa.array(c, pa.bool_() if i == 5 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([of.values.field("id"), *columns], names)

    return run


def manifest(
    docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), found: dict[str, Column] | None = None, depth: int = DEPTH
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A row's leaf is the digest of its ``fields``; rows of one ``tree_col`` are a tree, by ascending id, and the trees' subroots, by their names, one more.
    ``found`` replaces fields by what a later reading found: its leaf is folded with the recorded path, and ``verified`` says whether the root comes out.

    Null fields count as a hyphen, an empty text as ``0:``. Null ids come first in their tree, the null tree before all. Rows that share an id follow by
    their leaf; rows alike in all fields are leaves of their own. Ids are integers. Of an empty table no rows come. Only the columns named are read, so others can't clash.
    A tree may hold any share of the rows: its blocks are cut at ``2**depth`` leaves, and one path above a block is sent once a block.
    """
    of = {c: F.col(c) for c in fields}
    leaf = lambda new: F.unhex(F.sha2(F.concat(*[field((of | new)[c]) for c in fields]), 256))
    now = leaf(found) if found else F.lit(None).cast("binary")
    # the null tree sorts before the empty name
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).cast("binary")
    rows = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf({}).alias("leaf"), now.alias("found"))
    rows = materialise(rows.withColumn("found", F.when(F.col("found") != F.col("leaf"), F.col("found"))), "merkle-leaves")
    blocks = packed(numbered(rows, ["id", "leaf"], "merkle-numbered").select("tree", "n", "idx", "leaf", "id", "found"), "merkle-blocks", depth)
    stages, subroots = _all_roots(blocks, depth)
    upper = numbered(subroots.select(F.lit(b"").alias("tree"), F.col("tree").alias("name"), "leaf"), ["name"], "merkle-subroots")
    names = packed(upper.select("tree", "n", "idx", "leaf", "name"), "merkle-names", depth)
    top_stages, tops = _all_roots(names, depth)
    found_root = tops.select("leaf").first()
    shape = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if found_root is None:
        return docs.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    root = found_root[0].hex().encode()
    nothing = F.lit(b"")
    at_top = _down(top_stages[1:], tops.select("tree", F.col("idx").alias("block"), nothing.alias("sides"), nothing.alias("siblings"), nothing.alias("tag")), depth)
    # a name's path, by the tree it is the root of
    places = _lower(names, at_top, depth).select("block", "sides", "siblings")
    ids = names.select(F.explode("leaves").alias("x")).select(F.col("x.idx").alias("block"), F.col("x.name").alias("tree"), F.col("x.leaf").alias("subroot"))
    heads = materialise(ids.join(places, "block").select("tree", F.lit(0).cast("long").alias("block"), "sides", "siblings", F.col("subroot").alias("tag")), "merkle-heads")
    joined = _beside(blocks, _down(stages[1:], heads, depth))
    out = joined.mapInArrow(tidied(_leaf_rows(depth, root, shape.replace(",", "").split()[::2])), shape)
    return out.withColumnRenamed("id", id_col)


def _all_roots(blocks: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Packed stages from ``blocks`` on, and (tree, idx, leaf) of the roots of all trees."""
    stages, done = [blocks], None
    while True:
        roots = materialise(stages[-1].mapInArrow(tidied(_roots(depth)), "tree binary, n long, idx long, leaf binary"), "merkle-roots")
        ended = roots.where("n = 1").select("tree", "idx", "leaf")
        done = ended if done is None else done.unionByName(ended)
        more = roots.where("n > 1")
        if more.isEmpty():
            return stages, done
        stages.append(packed(more, "merkle-stage", depth))


def _beside(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    return blocks.join(paths, ["tree", "block"]).select("tree", "n", "block", "leaves", "sides", "siblings", "tag")


def _lower(blocks: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """(tree, block, sides, siblings, tag) of the nodes of ``blocks``, where each node is a block of the stage below."""
    return _beside(blocks, paths).mapInArrow(tidied(_lower_paths(depth)), "tree binary, block long, sides binary, siblings binary, tag binary")


def _down(stages: list[DataFrame], heads: DataFrame, depth: int) -> DataFrame:
    """Paths of the lowest blocks' roots. heads: the paths of the trees' roots, as block 0.

    A tree that ends at a lower stage than others has its root among that stage's blocks already.
    """
    paths = heads
    for blocks in reversed(stages):
        lower = _lower(blocks, paths, depth)
        # trees without blocks at this stage keep the path of their root
        ended = paths.join(blocks.select("tree", "block"), ["tree", "block"], "left_anti").select("tree", "block", "sides", "siblings", "tag")
        paths = materialise(lower.unionByName(ended), "merkle-paths")
    return paths
