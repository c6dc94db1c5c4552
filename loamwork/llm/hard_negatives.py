"""Hard-negative mining by blocked matrix products in float64.

Vectors become integers and are packed into tiles. Anchors, a stated share of the rows, are packed into blocks of their own; blocks of
a checked size are broadcast against all tiles, and beyond it blocks and tiles meet in a grid. A first pass keeps the best
positives of each anchor: a task keeps a running list, lists are merged by rank. The second pass gives each block its positives' windows of
scores and keeps the best negatives inside each window the same way. A product is exact in float64 below 2^53; rows whose
components could bring it beyond are multiplied as Python's integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.common import materialise, tidied
from loamwork.operators.tiles import TILE_BYTES, meet, pack

SCALE = 256
_TILE = "dim int, n int, bytes long, kind string, ids binary, labels binary, vectors binary"
_LONG = 2**63


def _quantised(batch: pa.RecordBatch, most_rows: int) -> Iterator[dict]:
    """Tiles of (id, label, vector): floor(256 x) of rows whose components are all finite, by their number of components."""
    vectors = batch.column(2)
    good = pc.and_(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()), vectors.is_valid()).to_numpy(zero_copy_only=False)
    ends, flat = vectors.offsets.to_numpy(), vectors.values
    sizes = np.diff(ends)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        values[flat.is_null().to_numpy(zero_copy_only=False)] = np.nan
    with np.errstate(over="ignore"):
        values = np.floor(SCALE * values)
    ids, labels = (batch.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8") for k in (0, 1))
    for dim in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == dim))
        rows = values[ends[:-1][at][:, None] + np.arange(dim)]
        fine = np.isfinite(rows).all(axis=1)
        at, rows = at[fine], rows[fine]
        step = max(1, min(most_rows, TILE_BYTES // (2 * max(1, int(dim)))))
        for k in range(0, len(at), step):
            own, m = at[k : k + step], rows[k : k + step]
            top = np.abs(m).max(initial=0)
            kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
            blob = m.astype(kind).tobytes()
            yield {"dim": int(dim), "n": len(own), "bytes": len(blob) + 16 * len(own), "kind": kind, "ids": ids[own].tobytes(), "labels": labels[own].tobytes(), "vectors": blob}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole float64 numbers: float64 while exact, else an array of Python's integers, at most those of a long."""
    dim = max(1, a.shape[1])
    tops = np.abs(a).max(initial=0), np.abs(b).max(initial=0)
    if dim * max(1.0, tops[0]) * max(1.0, tops[1]) < 2**53:
        return a @ b.T
    limit = (2**53 / dim) ** 0.5
    small = [np.abs(m).max(axis=1, initial=0) < limit for m in (a, b)]
    exact = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    out = np.empty((len(a), len(b)), object)
    safe = (a[small[0]] @ b[small[1]].T).astype(np.int64)
    out[np.ix_(small[0], small[1])] = safe.astype(object)
    for rows, columns in ((~small[0], np.ones(len(b), bool)), (small[0], ~small[1])):
        if rows.any() and columns.any():
            out[np.ix_(rows, columns)] = np.clip(exact[0][rows].dot(exact[1][columns].T), -_LONG, _LONG - 1)
    return out


class Running:
    """The ``k`` best (score falling, id rising) of each of ``n`` lists."""

    def __init__(self, n: int, k: int):
        self.k, self.line = k, np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, max(100_000, 4 * n * k)

    def add(self, own: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """scores, allowed: (lists ``own``, ids). What ties with the last place stays until ids break it."""
        picked = allowed & (scores >= self.line[own][:, None]).astype(bool)
        many = np.flatnonzero(np.count_nonzero(picked, axis=1) > 4 * self.k)
        if len(many) and scores.dtype != object:
            some = np.where(picked[many], scores[many], -np.inf)
            picked[many] &= some >= np.partition(some, -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(picked)
        if len(i):
            self.held.append((own[i], scores[i, j], ids[j]))
            self.size += len(i)
            if self.size > self.most:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, scores, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        if scores.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda t: (q[t], -scores[t], ids[t])), np.int64)
            self.line = self.line.astype(object)
        else:
            order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        starts = np.searchsorted(q, np.arange(len(self.line) + 1))
        keep = np.arange(len(q)) - starts[q] < self.k
        full = np.diff(starts) >= self.k
        self.line[full] = scores[starts[:-1][full] + self.k - 1]
        self.held = [(q[keep], scores[keep], ids[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _longs(scores: np.ndarray) -> pa.Array:
    if scores.dtype == object:
        scores = np.array([int(s) for s in scores], np.int64)
    return pa.array(scores.astype(np.int64))


class _Pair:
    """A joined row: a block of anchors and a tile of candidates."""

    def __init__(self, row: dict[str, pa.Scalar]):
        of = lambda side, name, kind: np.frombuffer(row[f"{side}_{name}"].as_buffer(), kind)
        self.block, self.n = row["a_tile"].as_py(), row["a_n"].as_py()
        self.same_size = row["a_dim"].as_py() == row["c_dim"].as_py()
        self.anchors, self.a_labels, self.ids, self.labels = of("a", "ids", "<i8"), of("a", "labels", "<i8"), of("c", "ids", "<i8"), of("c", "labels", "<i8")
        matrix = lambda side: of(side, "vectors", row[f"{side}_kind"].as_py()).reshape(row[f"{side}_n"].as_py(), -1).astype(np.float64)
        self.left, self.right = lambda: matrix("a"), lambda: matrix("c")

    def windows(self, row: dict[str, pa.Scalar], slots: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest score of each anchor's positives; an empty window where there is none."""
        found = row["a_positives"].values
        place, slot, score = (pc.struct_field(found, k).to_pylist() for k in range(3))
        least, most = np.full((self.n, slots), np.inf), np.full((self.n, slots), -np.inf)
        if any(abs(s) >= 2**52 for s in score):
            least, most = least.astype(object), most.astype(object)
        for p, k, s in zip(place, slot, score, strict=True):
            least[p, k], most[p, k] = -(-low * s // 100), high * s // 100
        return least, most


def _flush(lists: dict[int, Running], slots: int) -> Iterator[pa.RecordBatch]:
    for block, best in lists.items():
        q, scores, ids = best.cut()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(q // slots), pa.array(q % slots), pa.array(ids.astype(np.int64)), _longs(scores)], ["block", "place", "slot", "id", "score"])


def _scan(slots: int, k: int, low: int | None = None, high: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Without a window the best ``k`` of the anchor's label, else of each of ``slots`` windows the best ``k`` of other labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, Running] = {}
        cell = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(c)[at] for c, name in enumerate(batch.schema.names)}
                if row["cell"].as_py() != cell:
                    yield from _flush(lists, slots)
                    lists, cell = {}, row["cell"].as_py()
                pair = _Pair(row)
                if not pair.same_size or not len(pair.ids):
                    continue
                if pair.block not in lists:
                    lists[pair.block] = Running(pair.n * slots, k)
                scores = products(pair.left(), pair.right())
                alike = pair.a_labels[:, None] == pair.labels[None, :]
                if low is None:
                    lists[pair.block].add(np.arange(pair.n), scores, alike & (pair.anchors[:, None] != pair.ids[None, :]), pair.ids)
                    continue
                least, most = pair.windows(row, slots, low, high)
                for slot in range(slots):
                    inside = ~alike & (scores >= least[:, slot, None]).astype(bool) & (scores <= most[:, slot, None]).astype(bool)
                    lists[pair.block].add(np.arange(pair.n) * slots + slot, scores, inside, pair.ids)
        yield from _flush(lists, slots)

    return run


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    """Merges the tasks' lists: the first ``k`` of each, ranked from 1; the limit holds within map tasks too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    tile: int = 4096,
    block: int = 1024,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all scores inner products of floor(256 x).

    anchor: which rows are anchors, of ``id``, ``label``. An anchor's positives are its best other rows of the same label; to each, the
    best rows of other labels whose score is from ``low`` to ``high`` hundredths of the positive's. Ties go to the smaller id.

    Rows with a null id, label, vector or component, or a component that is not finite times 256, take no part; extra columns are not read, so their names can't clash.
    Rows that repeat an id are rows of their own: each takes a rank, none is a positive of its namesake, and an anchor that comes twice is answered twice.
    Vectors of different lengths have no score with each other; those of length 0 score 0. A score beyond the range of a long counts as the nearest long.
    An anchor without positives, or a positive without negatives in its window, gives no row; an empty table gives none.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    tiles = materialise(pack(rows, lambda b: _quantised(b, tile), _TILE), "negatives-tiles")
    chosen = rows.where(anchor & F.col("label").isNotNull() & F.col("vector").isNotNull())
    chosen = materialise(chosen, "negatives-anchors")
    parts = max(1, -(-chosen.count() // block))
    blocks = materialise(pack(chosen.repartition(parts, F.xxhash64("id")), lambda b: _quantised(b, block), _TILE), "negatives-blocks")
    shape = "block long, place long, slot long, id long, score long"
    first = meet(blocks, tiles).mapInArrow(tidied(_scan(1, positives)), shape)
    best = materialise(_best(first, positives, "block", "place").select("block", "place", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    windows = best.groupBy(F.col("block").alias("tile")).agg(F.collect_list(F.struct("place", "slot", F.col("positive_score").alias("score"))).alias("positives"))
    asked = materialise(blocks.join(windows, "tile"), "negatives-windows")
    second = meet(asked, tiles).mapInArrow(tidied(_scan(positives, negatives, low, high)), shape)
    ranked = _best(second, negatives, "block", "place", "slot")
    named = blocks.mapInArrow(_named, "block long, place long, anchor_id long")
    return (
        ranked.join(best.withColumn("slot", F.col("slot").cast("long")), ["block", "place", "slot"])
        .join(named, ["block", "place"])
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each block's anchors by their places."""
    for batch in batches:
        at = {name: k for k, name in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            ids = np.frombuffer(batch.column(at["ids"])[k].as_buffer(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column(at["tile"])[k].as_py())), pa.array(np.arange(len(ids))), pa.array(ids)], ["block", "place", "anchor_id"])
