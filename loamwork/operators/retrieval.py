"""Ranked retrieval over many queries at once.

``hits`` tables have (q_id, id, rank from 0, score). Scores are rounded before they
are ranked, so order does not hang on the last bit; ids break ties.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.text import CONNECTORS, lexical_tokens, saturated
from loamwork.operators.tiles import BLOCK_BYTES, TILE_BYTES, meet, pack, rows_of
from loamwork.storage import materialise

DIGITS = 6


def ranked(hits: DataFrame, *order: Column, by: str = "q_id", limit: int | None = None) -> DataFrame:
    """Rank from 0 within ``by``; a limit is applied within map tasks too, before the shuffle."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return out.where(F.col("rank") < limit) if limit else out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column; null ones and those of another size are zero."""
    ends = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    good = (np.diff(ends) == size) & vectors.is_valid().to_numpy(zero_copy_only=False)
    if good.all():
        return np.nan_to_num(values[ends[0] : ends[-1]].reshape(-1, size))
    out = np.zeros((len(vectors), size))
    out[good] = np.nan_to_num(values[ends[:-1][good][:, None] + np.arange(size)])
    return out


def _reaching(scores: np.ndarray, line: np.ndarray, most: int | None = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Places (row, column) and rounded cosines of those that reach their row's line when rounded. None if over ``most`` a row come near it."""
    at = np.flatnonzero(scores >= (line - 10.0**-DIGITS)[:, None])
    if most is not None and len(at) > most * len(scores):
        return None
    i, j = np.divmod(at, scores.shape[1])
    rounded = np.round(scores[i, j], DIGITS) + 0.0
    good = rounded >= line[i]
    return i[good], j[good], rounded[good]


class _Best:
    """The ``k`` best (score falling, id rising) of each query so far; an id counts once, with its best score."""

    def __init__(self, n: int, k: int):
        self.k, self.line = k, np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 4 * n * k

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: (queries from ``first`` on, ids), -inf for what doesn't count."""
        line = self.line[first : first + len(scores)]
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
        if len(starts) < len(ids):
            scores, ids = np.maximum.reduceat(scores[:, order], starts, axis=1), ids[order][starts]
        if scores.shape[1] > self.k:
            line = np.maximum(line, np.partition(scores, -self.k, axis=1)[:, -self.k])
        # ties at the line stay; ids break them when the rest goes
        i, j = np.nonzero((scores >= line[:, None]) & (scores > -np.inf))
        self.held.append((i + first, ids[j], scores[i, j]))
        self.size += len(i)
        if self.size > self.most:
            self.cut()

    def put(self, first: int, scores: np.ndarray, one: np.ndarray, two: np.ndarray, floor: float | None, skip_self: bool) -> None:
        """As ``add``, of cosines that are not rounded: while few reach the lines, only these are rounded and looked at."""
        line = self.line[first : first + len(scores)]
        line = line if floor is None else np.maximum(line, floor)
        found = _reaching(scores, line) if (line > -np.inf).all() else None
        if found is None:
            scores = np.round(scores, DIGITS) + 0.0
            if floor is not None:
                scores[scores < floor] = -np.inf
            if skip_self:
                scores[one[:, None] == two[None, :]] = -np.inf
            return self.add(first, scores, two)
        i, j, rounded = found
        if skip_self:
            other = one[i] != two[j]
            i, j, rounded = i[other], j[other], rounded[other]
        if len(i):
            self.held.append((i + first, two[j], rounded))
            self.size += len(i)
            if self.size > self.most:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((-scores, ids, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])][: len(q)]
        q, ids, scores = q[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        starts = np.searchsorted(q, np.arange(len(self.line) + 1))
        keep = np.arange(len(q)) - starts[q] < self.k
        full = np.diff(starts) >= self.k
        self.line[full] = scores[starts[:-1][full] + self.k - 1]
        self.held = [(q[keep], ids[keep], scores[keep])]
        self.size = int(keep.sum())
        return self.held[0]


_TILE = "dim int, n int, bytes long, ids binary, rows binary, centre binary, spread double"


def cosine_tiles(rows: DataFrame, tile: int = 2048) -> DataFrame:
    """Tiles of (id, vector) as unit rows, one length of vectors each, with the cone they lie in: its centre, and the widest angle to it. A null vector has length 0."""

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        vectors = batch.column(1)
        sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy()), 0)
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            step = max(1, min(tile, TILE_BYTES // (8 * max(1, int(dim)))))
            for k in range(0, len(at), step):
                own = at[k : k + step]
                m = _unit(_matrix(vectors.take(pa.array(own)), int(dim))) if dim else np.zeros((len(own), 0))
                centre = _unit(m.sum(axis=0, keepdims=True))
                # rows without length fit no cone
                spread = float(np.arccos(np.clip((m @ centre[0]).min(), -1, 1))) if dim and m.any(axis=1).all() else np.pi
                yield {"dim": int(dim), "n": len(own), "bytes": m.nbytes + 8 * len(own), "ids": ids[own].tobytes(), "rows": m.tobytes(), "centre": centre.tobytes(), "spread": spread}

    return pack(rows.select("id", "vector"), cut, _TILE)


#: Held rows that meet a tile of queries at once in a scan: a matrix of cosines, of which there are some copies, is 8 MB then.
SCAN_ROWS = 512


def _met(batches: Iterator[pa.RecordBatch], floor: float | None = None, step: int | None = None, rounded: bool = True) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Along joined tiles: the row's numbers, asked ids, held ids and (if not said otherwise, rounded) cosines, ``step`` held ids at once if given. With a floor, tiles whose cones are too far apart are passed over."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
            at = {name: row[name].as_py() for name in ("cell", "a_tile", "c_tile", "a_n", "c_n", "a_dim", "c_dim")}
            alike = at["a_dim"] == at["c_dim"] > 0
            if floor is not None and floor > 0:
                if not alike:
                    continue
                between = float(np.arccos(np.clip(rows_of(row["a_centre"], at["a_dim"])[0] @ rows_of(row["c_centre"], at["a_dim"])[0], -1, 1)))
                if between - row["a_spread"].as_py() - row["c_spread"].as_py() > np.arccos(np.clip(floor, -1, 1)) + 1e-3:
                    continue
            one, two = (np.frombuffer(row[c].as_buffer(), "<i8") for c in ("a_ids", "c_ids"))
            for c in range(0, len(two), step or max(1, len(two))):
                some = two[c : c + step] if step else two
                if alike:
                    scores = rows_of(row["a_rows"], at["a_dim"]) @ rows_of(row["c_rows"], at["c_dim"])[c : c + len(some)].T
                    if rounded:
                        np.round(scores, DIGITS, out=scores)
                        scores += 0.0
                else:
                    scores = np.zeros((len(one), len(some)))
                yield at, one, some, scores


def cosine_scan(corpus: DataFrame, queries: DataFrame, k: int | None, floor: float | None = None, skip_self: bool = False, block: int = BLOCK_BYTES, tile: int = 2048) -> DataFrame:
    """(q_id, id, score) of the corpus rows nearest each query, by exact cosine.

    corpus: (id, vector); queries: (q_id, vector). Both are packed into tiles, and tiles meet in a grid: query tiles of up to ``block`` bytes are
    broadcast, more are dealt to cells, and the driver sees no row. A task keeps the best ``k`` of the queries of its cell along all its tiles, so what it
    sends on does not grow with the corpus; an id that repeats counts with its best row. Without ``k`` each pair goes on.
    ``floor`` keeps what reaches it. Vectors without length or of another size score 0; queries without a vector find nothing.
    """
    asked = materialise(cosine_tiles(queries.where(F.col("vector").isNotNull()).select(F.col("q_id").alias("id"), "vector"), tile), "asked-tiles")
    names = ["q_id", "id", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, _Best]] = {}
        cell = None

        def flush() -> Iterator[pa.RecordBatch]:
            for ids, best in held.values():
                i, found, scores = best.cut()
                yield pa.RecordBatch.from_arrays([pa.array(ids[i].astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(scores)], names)
            held.clear()

        for at, one, two, scores in _met(batches, floor, SCAN_ROWS, rounded=not k):
            if at["cell"] != cell:
                yield from flush()
                cell = at["cell"]
            if k:
                if at["a_tile"] not in held:
                    held[at["a_tile"]] = one.copy(), _Best(len(one), k)
                held[at["a_tile"]][1].put(0, scores, one, two, floor, skip_self)
                continue
            if floor is not None:
                scores[scores < floor] = -np.inf
            if skip_self:
                scores[one[:, None] == two[None, :]] = -np.inf
            i, j = np.nonzero(scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(one[i]), pa.array(two[j]), pa.array(scores[i, j])], names)
        yield from flush()

    met = meet(asked, cosine_tiles(corpus, tile), block, write=lambda t: materialise(t, "held-tiles"))
    return met.mapInArrow(scan, "q_id long, id long, score double")


def _among(vectors: DataFrame, block: int, tile: int) -> DataFrame:
    """Every pair of a table's tiles once."""
    tiles = materialise(cosine_tiles(vectors.where(F.col("vector").isNotNull()), tile), "own-tiles")
    return meet(tiles, tiles, block).where("a_tile <= c_tile")


def cosine_links(vectors: DataFrame, floor: float, block: int = BLOCK_BYTES, tile: int = 2048) -> DataFrame:
    """(u, v): links that join just what cosines of ``floor`` or more join among all rows (id, vector). A pair of tiles gives a star for each group that hangs together in it, so a dense group costs as many rows as it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, one, two, scores in _met(batches, floor, rounded=False):
            i, j, _ = _reaching(scores, np.full(len(one), floor), None)
            # the smallest id that each row reaches, handed on until nothing changes
            left, right = one.copy(), two.copy()
            linked, met = np.zeros(len(one), bool), np.zeros(len(two), bool)
            linked[i], met[j] = True, True
            while len(i):
                left_new, right_new = left.copy(), right.copy()
                np.minimum.at(left_new, i, right[j])
                np.minimum.at(right_new, j, left_new[i])
                if (left_new == left).all() and (right_new == right).all():
                    break
                left, right = left_new, right_new
            u, v = np.concatenate([one[linked], two[met]]), np.concatenate([left[linked], right[met]])
            apart = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], ["u", "v"])

    return _among(vectors, block, tile).mapInArrow(run, "u long, v long").distinct()


def cosine_counts(vectors: DataFrame, block: int = BLOCK_BYTES, tile: int = 2048) -> DataFrame:
    """(score, n): how many pairs of different rows (id, vector) have each rounded cosine. A task sends one row a score, of two million and one that there are."""
    unit = 10**DIGITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * unit + 1, np.int64)
        for at, one, two, scores in _met(batches):
            if at["a_tile"] == at["c_tile"]:
                scores = scores[np.triu_indices(len(one), 1)]
            found, n = np.unique(np.rint((scores.ravel() + 1) * unit).astype(np.int64), return_counts=True)
            counts[np.clip(found, 0, 2 * unit)] += n
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there - unit), pa.array(counts[there])], ["s", "n"])

    counted = _among(vectors, block, tile).mapInArrow(run, "s long, n long")
    return counted.groupBy("s").agg(F.sum("n").alias("n")).select((F.col("s") / unit).alias("score"), "n")


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, skip_self: bool = False) -> DataFrame:
    """(q_id, id, rank, score): the ``k`` nearest, score falling, id rising."""
    return ranked(cosine_scan(corpus, queries, k, skip_self=skip_self), F.desc("score"), F.asc("id"), limit=k).select("q_id", "id", "rank", "score")


def neighbour_pairs(corpus: DataFrame, queries: DataFrame, per_point: int = 5, floor: float = 0.88) -> DataFrame:
    """(a_id, b_id, score), a < b: the ``per_point`` nearest others of each query at ``floor`` or more."""
    near = ranked(cosine_scan(corpus, queries, per_point, floor, skip_self=True), F.desc("score"), F.asc("id"), limit=per_point)
    return near.select(F.least("q_id", "id").alias("a_id"), F.greatest("q_id", "id").alias("b_id"), "score").distinct()


def max_similarity(centroids: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Best centroid of each artifact: centroids (id, vector) may repeat an id.

    An artifact of the best ``k`` is one of the best ``k`` of the task that holds its best centroid, so tasks send no more than that.
    """
    best = cosine_scan(centroids, queries, k).groupBy("q_id", "id").agg(F.max("score").alias("score"))
    return ranked(best, F.desc("score"), F.asc("id"), limit=k).select("q_id", "id", "rank", "score")


_RUN, _PARTS = re.compile(r"[\w\-./]+"), re.compile(r"[\-_./]+")


def terms_of(text: str | None) -> list[str]:
    """The same terms as ``lexical_tokens`` finds, in the same order."""
    runs = [t.strip(CONNECTORS).lower() for t in _RUN.findall(text or "")]
    parts = [p for t in runs if _PARTS.search(t) for p in _PARTS.split(t)]
    return [t for t in runs + parts if t and (len(t) <= 10 or len(t.encode()) <= 40)]


def postings(docs: DataFrame, text: str = "text", only: frozenset[str] | None = None) -> DataFrame:
    """(id, term, tf) of a table with ``id`` and a text; with ``only``, of these terms. Counted per document in one Arrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else None
        for batch in batches:
            places, found, times = [], [], []
            for k, value in enumerate(batch.column(1)):
                terms = terms_of(value.as_py())
                counts = Counter(terms if wanted is None else [t for t in terms if t in wanted])
                places += [k] * len(counts)
                found += counts.keys()
                times += counts.values()
                if len(places) > 200_000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(found, pa.string()), pa.array(times, pa.int64())], ["id", "term", "tf"])
                    places, found, times = [], [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(found, pa.string()), pa.array(times, pa.int64())], ["id", "term", "tf"])

    return docs.select("id", text).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, term string, tf long")


def posting_lists(docs: DataFrame, only: frozenset[str] | None = None, text: str = "text") -> DataFrame:
    """(id, terms, tfs) of each document that has a term, with ``only`` one of these: its row as the pass over the texts makes it, nothing to bring together."""
    shared = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                counts = [Counter(t for t in terms_of(value.as_py()) if wanted is None or t in wanted) for value in batch.column(1)]
                some = pa.array([k for k, c in enumerate(counts) if c], pa.int64())
                terms, tfs = pa.array([list(c) for c in counts if c], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts if c], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), terms, tfs], ["id", "terms", "tfs"])

    return docs.select("id", text).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, terms array<string>, tfs array<long>")


#: Up to so many terms of a query set go to the tasks that read the documents, and up to so many weights of terms by queries.
TERMS, WEIGHTS = 200_000, 4_000_000


def _scored(shared, k: int):
    """Input: (id, terms, tfs) of documents; output: a task's own best ``k`` of each query by weights of terms by queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, places, weights = shared.value
        best = _Best(len(q_ids), k)
        size = max(1, min(1024, 2_000_000 // max(1, len(q_ids))))
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                scores = np.zeros((some.num_rows, len(q_ids)))
                for row, (terms, tfs) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    if terms:
                        tf = np.array(tfs, np.float64)
                        scores[row] = (tf * 2.2 / (tf + 1.2)) @ weights[[places[t] for t in terms]]
                # weights are above zero, so a score is if a term is shared
                best.add(0, np.where(scores > 0, np.round(scores, DIGITS), -np.inf).T, ids[at : at + size])
        i, found, scores = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(found.astype(np.int64)), pa.array(scores)], ["q_id", "id", "score"])

    return run


#: Of documents in a tile of posting lists, of postings in it, of queries that meet tiles together, and of groups of tiles that each send on a best list.
TILE_DOCS, TILE_POSTINGS, BLOCK_QUERIES, GROUPS = 32_768, 4_000_000, 32_768, 64
_LISTS = "part int, ids binary, starts binary, terms array<string>, places binary, values binary"


def _inverted(ids: np.ndarray, terms: pa.Array, places: np.ndarray, tfs: np.ndarray) -> tuple:
    """Posting lists, one a term: where each starts, the terms, and in the lists the places of documents and the frequencies."""
    coded = terms.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    return ids.astype("<i8").tobytes(), starts.astype("<i8").tobytes(), coded.dictionary.to_pylist(), places[order].astype("<i4").tobytes(), tfs[order].astype("<f8").tobytes()


def _list_tiles(most_docs: int, most_postings: int):
    """Input: (id, terms, tfs); output: tiles of posting lists, numbered by the partition they are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = TaskContext.get().partitionId(), [], 0

        def tile() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = whole.column(1)
            places = np.repeat(np.arange(whole.num_rows), np.diff(lists.offsets.to_numpy()))
            row = _inverted(whole.column(0).to_numpy(), lists.flatten(), places, whole.column(2).flatten().to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], kind) for x, kind in zip(row, kinds, strict=True))], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(batch.slice(at, 256))
                size += len(held[-1].column(1).flatten())
                if sum(b.num_rows for b in held) >= most_docs or size >= most_postings:
                    yield tile()
                    held, size = [], 0
        if held:
            yield tile()

    kinds = [pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]
    names = ["part", "ids", "starts", "terms", "places", "values"]
    return run


def _query_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: (q_id, asked) of a partition; output: one row for all of it: of each query the places of its terms and their weights."""
    held = [b for b in batches if b.num_rows]
    if held:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lists = whole.column(1)
        coded, weights = lists.flatten().field("term").dictionary_encode(), lists.flatten().field("idf").to_numpy()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        row = [whole.column(0).to_numpy().astype("<i8").tobytes(), starts.astype("<i8").tobytes(), coded.dictionary.to_pylist(), coded.indices.to_numpy().astype("<i4").tobytes(), weights.astype("<f8").tobytes()]
        kinds = [pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        part = pa.array([TaskContext.get().partitionId()], pa.int32())
        yield pa.RecordBatch.from_arrays([part, *(pa.array([x], kind) for x, kind in zip(row, kinds, strict=True))], ["part", "ids", "starts", "terms", "places", "values"])


class _Lists:
    """A row of posting lists or of queries."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        blob = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)
        self.ids, self.starts, self.terms = blob("ids", "<i8"), blob("starts", "<i8"), batch.column("terms")[k].values
        self.places, self.values = blob("places", "<i4"), blob("values", "<f8")


def _asked_of(block: _Lists, tile: _Lists, best: _Best) -> None:
    """Takes each query's best of a tile: its terms' lists summed up by document. Lists of many documents are added as whole vectors."""
    n, k = len(tile.ids), best.k
    at = pc.fill_null(pc.index_in(block.terms, value_set=tile.terms), -1).to_numpy()[block.places]
    saturation = tile.values * 2.2 / (tile.values + 1.2)
    whole: dict[int, np.ndarray] = {}
    order = np.argsort(tile.ids, kind="stable")
    firsts = np.flatnonzero(np.r_[True, tile.ids[order][1:] != tile.ids[order][:-1]])
    again, ids = len(firsts) < n, tile.ids
    if again:
        ids = tile.ids[order][firsts]
    total, product = np.zeros(n), np.empty(n)
    for q in range(len(block.ids)):
        s, e = block.starts[q], block.starts[q + 1]
        total[:] = 0
        for p, weight in zip(at[s:e].tolist(), block.values[s:e].tolist(), strict=True):
            if p < 0:
                continue
            a, b = tile.starts[p], tile.starts[p + 1]
            if 8 * (b - a) > n:
                if p not in whole:
                    whole[p] = np.zeros(n)
                    whole[p][tile.places[a:b]] = saturation[a:b]
                np.multiply(whole[p], weight, out=product)
                np.add(total, product, out=total)
            else:
                total[tile.places[a:b]] += weight * saturation[a:b]
        # an id that comes again counts with its best row
        scores = np.maximum.reduceat(total[order], firsts) if again else total
        # weights are above zero, so a score is if a term is shared; what may round to the line stays
        near = np.flatnonzero(scores >= best.line[q] - 10.0**-DIGITS) if best.line[q] > 0 else np.flatnonzero(scores)
        if len(near) > k:
            some = scores[near]
            near = near[some >= np.partition(some, -k)[-k] - 10.0**-DIGITS]
        if len(near):
            best.held.append((np.full(len(near), q), ids[near], np.round(scores[near], DIGITS)))
    best.cut()


def _lists_scan(k: int):
    """Input: rows of one cell after another, the block of queries first, then its tiles; output: a cell's own best ``k`` of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = block = best = None

        def flush() -> Iterator[pa.RecordBatch]:
            if best is not None:
                i, found, scores = best.cut()
                yield pa.RecordBatch.from_arrays([pa.array(block.ids[i].astype(np.int64)), pa.array(found.astype(np.int64)), pa.array(scores)], ["q_id", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("cell")[row].as_py() != cell:
                    yield from flush()
                    cell, block, best = batch.column("cell")[row].as_py(), None, None
                if batch.column("kind")[row].as_py() == 0:
                    block = _Lists(batch, row)
                    best = _Best(len(block.ids), k)
                elif block is not None:
                    _asked_of(block, _Lists(batch, row), best)
        yield from flush()

    return run


def _by_lists(found: DataFrame, weighted: DataFrame, n_queries: int, k: int) -> DataFrame:
    """(q_id, id, score): each query's best of every group of tiles, for any number of queries and terms.

    found: (id, terms, tfs), written; weighted: (q_id, term, idf). Documents become tiles of posting lists, queries blocks, and the two meet in a grid of cells by a shuffle
    of these alone: a pair of query and document exists only as a sum in a vector of its tile. A task holds one block, its best lists and one tile.
    """
    spark = found.sparkSession
    found = found.where("id is not null").select(F.col("id").cast("long").alias("id"), "terms", "tfs")
    n = found.count()
    tiles = max(1, -(-n // TILE_DOCS), min(2 * spark.sparkContext.defaultParallelism, n // 2048))
    groups, blocks = min(tiles, GROUPS), max(1, -(-n_queries // BLOCK_QUERIES))
    held = found.repartition(tiles, "id").mapInArrow(_list_tiles(TILE_DOCS, TILE_POSTINGS), _LISTS)
    asked = weighted.where("q_id is not null").groupBy(F.col("q_id").cast("long").alias("q_id")).agg(F.collect_set(F.struct("term", "idf")).alias("asked"))
    asked = asked.repartition(blocks, "q_id").mapInArrow(_query_block, _LISTS)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    one = asked.withColumn("g", every(groups)).withColumn("cell", F.col("g") * blocks + F.col("part")).withColumn("kind", F.lit(0))
    two = held.withColumn("h", every(blocks)).withColumn("cell", F.col("part") % groups * blocks + F.col("h")).withColumn("kind", F.lit(1))
    shape = ["cell", "kind", "ids", "starts", "terms", "places", "values"]
    met = one.select(*shape).unionByName(two.select(*shape)).repartitionById(groups * blocks, "cell").sortWithinPartitions("cell", "kind")
    return met.mapInArrow(_lists_scan(k), "q_id long, id long, score double")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(q_id, id, rank, score) by summed idf * saturated tf, without length norm.

    docs: (id, text); queries: (q_id, text). A query's terms count once. Documents are read once, for the queries'
    terms alone while these are few, and what is found is written, as both document frequencies and scores need it. Where ids are numbers and terms by queries
    are few enough, their weights go to the tasks as one matrix, and each task sends its own best on; beyond that, blocks of queries meet tiles of posting lists.
    Ids that are no numbers are scored by a join of terms.
    """
    terms = postings(queries.withColumnRenamed("q_id", "id")).select(F.col("id").alias("q_id"), "term")
    asked = terms.select("term").distinct()
    some = [r.term for r in asked.limit(TERMS + 1).collect()]
    only = frozenset(some) if len(some) <= TERMS else None
    n_queries = queries.count()
    numbered = {docs.schema["id"].dataType.simpleString(), queries.schema["q_id"].dataType.simpleString()} <= {"int", "bigint"}
    in_matrix = numbered and only is not None and len(some) * n_queries <= WEIGHTS
    if numbered:
        found = posting_lists(docs, only)
    else:
        found = postings(docs, only=only) if only is not None else postings(docs).join(asked, "term", "left_semi")
    found = materialise(found, "bm25-postings")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    each = found.select(F.explode("terms").alias("term")) if numbered else found
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row beside every term: a scalar, not a product
    idf = df.join(F.broadcast(n)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    weighted = terms.join(idf, "term")
    if in_matrix:
        # at most as many rows as the matrix has places
        rows = weighted.select(F.col("q_id").cast("long"), "term", "idf").where("q_id is not null").toArrow().combine_chunks()
        names, q_ids = pc.unique(rows["term"]).sort(), np.unique(rows["q_id"].to_numpy())
        weights = np.zeros((len(names), len(q_ids)))
        weights[pc.index_in(rows["term"], names).to_numpy(), np.searchsorted(q_ids, rows["q_id"].to_numpy())] = rows["idf"].to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast((q_ids.astype(np.int64), {t: i for i, t in enumerate(names.to_pylist())}, weights))
        scored = found.where("id is not null").mapInArrow(_scored(shared, k), "q_id long, id long, score double")
    elif numbered:
        scored = _by_lists(found, weighted, n_queries, k)
    else:
        scored = found.join(weighted, "term").groupBy("q_id", "id").agg(F.round(F.sum(F.col("idf") * saturated(F.col("tf"))), DIGITS).alias("score"))
    return ranked(scored, F.desc("score"), F.asc("id"), limit=k).select("q_id", "id", "rank", "score")


def rrf_fusion(branches: list[DataFrame], constant: int = 60, first: int = 1, limit: int | None = 10) -> DataFrame:
    """(q_id, id, rank, score): sums of 1 / (constant + position), positions from ``first``."""
    every = None
    for b in branches:
        part = b.select("q_id", "id", (1.0 / (F.col("rank") + constant + first)).alias("part"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("q_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return ranked(fused, F.desc("score"), F.asc("id"), limit=limit).select("q_id", "id", "rank", "score")


def dense_where_lexical_is_silent(fused: DataFrame, dense: DataFrame, terms: DataFrame) -> DataFrame:
    """Fused hits, but the dense ones for queries without a term. terms: (q_id, term)."""
    spoken = terms.select("q_id").distinct()
    return fused.join(spoken, "q_id", "left_semi").unionByName(dense.join(spoken, "q_id", "left_anti"))


def final_score(hits: DataFrame, at: int, recency: float = 0.05, half_life_days: float = 180, pinned: float = 0.15) -> DataFrame:
    """Adds recency decay and the pinned boost to what was retrieved, and ranks anew. Needs verified_at and tags."""
    age = F.greatest(F.lit(at) - F.coalesce("verified_at", F.lit(at)), F.lit(0))
    boost = F.when(F.coalesce(F.array_contains("tags", "pinned"), F.lit(False)), F.lit(pinned)).otherwise(0.0)
    score = F.round(F.col("score") + recency * F.pow(F.lit(2.0), -age / (half_life_days * 86400.0)) + boost, DIGITS)
    return ranked(hits.drop("rank").withColumn("score", score), F.desc("score"), F.asc("id"))


def with_similarity(hits: DataFrame, dense: DataFrame, weak_below: float = 0.35) -> DataFrame:
    """Raw cosine where the dense branch has one; null, which is never weak, elsewhere."""
    side = dense.select("q_id", "id", F.col("score").alias("similarity"))
    return hits.join(side, ["q_id", "id"], "left").withColumn("weak", F.coalesce(F.col("similarity") < weak_below, F.lit(False)))


def diversity_cap(hits: DataFrame, group: str, most: int = 3, target: int = 10) -> DataFrame:
    """At most ``most`` hits of each group; if fewer than ``target`` stay, displaced hits follow in order. Kept hits are never cut.

    For hits of one group each. Ranks are renumbered; ``displaced`` tells the refill.
    """
    within = Window.partitionBy("q_id", group).orderBy("rank")
    flagged = hits.withColumn("displaced", F.row_number().over(within) > most)
    whole = Window.partitionBy("q_id")
    kept = flagged.withColumn("n_kept", F.sum(F.when(~F.col("displaced"), 1).otherwise(0)).over(whole))
    order = Window.partitionBy("q_id").orderBy("displaced", "rank")
    new = kept.withColumn("new_rank", F.row_number().over(order) - 1)
    return new.where(~F.col("displaced") | (F.col("new_rank") < target)).drop("rank", "n_kept").withColumnRenamed("new_rank", "rank")


def diversity_cap_many(hits: DataFrame, groups: str, most: int = 3, target: int = 10) -> DataFrame:
    """The same for hits with an array of groups, all of which a kept hit counts against; a displaced hit counts against none.

    Order-dependent, so one query's hits (a bounded candidate list) are walked together.
    """

    def walk(pdf):
        pdf = pdf.sort_values("rank")
        seen: dict = {}
        kept, out = [], []
        for i, keys in zip(pdf.index, pdf[groups], strict=True):
            keys = list(keys) if keys is not None else []
            if any(seen.get(k, 0) >= most for k in keys):
                out.append(i)
                continue
            for k in keys:
                seen[k] = seen.get(k, 0) + 1
            kept.append(i)
        order = kept + out[: max(0, target - len(kept))]
        pdf = pdf.loc[order].copy()
        pdf["rank"] = range(len(pdf))
        pdf["displaced"] = [i in set(out) for i in order]
        return pdf

    schema = hits.withColumn("displaced", F.lit(True)).schema
    return hits.groupBy("q_id").applyInPandas(lambda pdf: walk(pdf)[schema.fieldNames()], schema)


def cliff(hits: DataFrame, factor: float = 3.0, least_share: float = 0.01) -> DataFrame:
    """(q_id, cliff_at): hits above the one gap that stands out, null if none does.

    The largest gap (the first of equals) must exceed ``factor`` times the mean of the
    others and ``least_share`` of the top score; lists under three hits have none; rises count 0.
    """
    w = Window.partitionBy("q_id").orderBy("rank")
    gaps = hits.select("q_id", "rank", "score", F.lead("score").over(w).alias("below")).withColumn("gap", F.greatest(F.round(F.col("score") - F.col("below"), 9), F.lit(0.0)))
    per = gaps.groupBy("q_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("below").isNotNull(), F.struct(F.col("gap"), (-F.col("rank")).alias("early")))).alias("top"),
        F.sum(F.when(F.col("below").isNotNull(), F.col("gap"))).alias("total"),
        F.max(F.when(F.col("rank") == 0, F.abs("score"))).alias("first"),
    )
    others = (F.col("total") - F.col("top.gap")) / (F.col("n") - 2)
    stands = (F.col("n") >= 3) & (F.col("top.gap") > 0) & (F.col("top.gap") > least_share * F.col("first")) & (F.round(F.col("top.gap") - factor * others, 9) > 0)
    return per.select("q_id", F.when(stands, 1 - F.col("top.early")).cast("long").alias("cliff_at"))


def mark_past_cliff(hits: DataFrame) -> DataFrame:
    """Adds ``past_cliff``; neither order nor rows change."""
    return hits.join(cliff(hits), "q_id", "left").withColumn("past_cliff", F.coalesce(F.col("rank") >= F.col("cliff_at"), F.lit(False))).drop("cliff_at")


def prime(hits: DataFrame, margin: float = 0.5, lift: int = 2) -> DataFrame:
    """Lifts hits by their activation: over up to ``lift`` predecessors each beaten by more than ``margin``; ranks 0 and 1 stay.

    Needs ``activation`` (null: none) and boolean ``sitting``. Activations are shares of the
    list's largest; a hit of the sitting counts as the largest. Adds ``primed``.
    """
    whole, order = Window.partitionBy("q_id"), Window.partitionBy("q_id").orderBy("rank")
    top = F.max(F.coalesce("activation", F.lit(0.0))).over(whole)
    share = F.when(top > 0, F.coalesce("activation", F.lit(0.0)) / top).otherwise(0.0)
    act = hits.withColumn("__act", F.when(F.col("sitting"), F.greatest(share, F.lit(1.0))).otherwise(share)).withColumn("__n", F.count(F.lit(1)).over(whole))
    climb, chain = F.lit(0), F.lit(True)
    for c in range(lift):
        beats = (F.col("rank") - c - 1 >= 1) & (F.round(F.col("__act") - F.lag("__act", c + 1).over(order), 9) > margin)
        chain = chain & F.coalesce(beats, F.lit(False))
        climb = climb + F.when(chain, 1).otherwise(0)
    moved = act.withColumn("__climb", F.when((F.col("__n") >= 3) & (F.col("rank") >= 2), climb).otherwise(0))
    place = Window.partitionBy("q_id").orderBy(F.col("rank") - F.col("__climb"), F.when(F.col("__climb") > 0, 0).otherwise(1), "rank")
    out = moved.withColumn("__new", F.row_number().over(place) - 1).withColumn("primed", F.col("__new") < F.col("rank"))
    return out.drop("rank", "__act", "__n", "__climb").withColumnRenamed("__new", "rank")


def facets(points: DataFrame, key: str = "category", limit: int = 20) -> DataFrame:
    """(value, n) of every point, whatever its status; a report of the ``limit`` most frequent."""
    return points.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def filter_artifacts(art: DataFrame, tags: tuple[str, ...] = (), category: str | None = None, corpus: object = None, superseded: bool = False, deprecated: bool = False) -> DataFrame:
    """All tags, the category, the corpus; superseded and deprecated rows only on demand. A missing status is active."""
    status = F.coalesce("status", F.lit("active"))
    if tags:
        art = art.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    if category is not None:
        art = art.where(F.col("category") == category)
    if corpus is not None:
        art = art.where(F.col("corpus_id") == F.lit(corpus))
    hidden = [s for s, shown in (("superseded", superseded), ("deprecated", deprecated)) if not shown]
    return art.where(~status.isin(*hidden)) if hidden else art


def links_from(links: DataFrame, anchors: DataFrame, at: int, half_life_days: float = 30) -> DataFrame:
    """(q_id, anchor_rank, id, weight) over links in both directions. anchors: (q_id, id, rank); links: (a_id, b_id, weight, bumped_at)."""
    from loamwork.functions.text import decayed

    weight = F.round(decayed(F.col("weight"), F.col("bumped_at"), at, half_life_days), DIGITS)
    ends = links.where("coalesce(state, 'learning') <> 'dismissed'") if "state" in links.columns else links
    both = ends.select(F.col("a_id").alias("from"), F.col("b_id").alias("to"), weight.alias("weight")).unionAll(ends.select("b_id", "a_id", weight))
    return anchors.select("q_id", F.col("rank").alias("anchor_rank"), F.col("id").alias("from")).join(both, "from").select("q_id", "anchor_rank", F.col("to").alias("id"), "weight")


def associated(hits: DataFrame, links: DataFrame, at: int, spread_from: int = 3, spread_max: int = 3, show_min: float = 2.0, half_life_days: float = 30) -> DataFrame:
    """Up to ``spread_max`` linked ids a query beyond its hits: (q_id, id, weight, place)."""
    near = links_from(links, hits.where(F.col("rank") < spread_from), at, half_life_days).where(F.col("weight") >= show_min)
    best = near.groupBy("q_id", "id").agg(F.max("weight").alias("weight"))
    fresh = best.join(hits.select("q_id", "id"), ["q_id", "id"], "left_anti")
    return ranked(fresh, F.desc("weight"), F.asc("id"), limit=spread_max).withColumnRenamed("rank", "place")


def pack_by_budget(hits: DataFrame, tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each query's hits whose tokens fit."""
    running = F.sum(tokens).over(Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", running).where(F.col("used") <= budget)


def merge_rounds(rounds: DataFrame, unvouched_first: int = 3) -> DataFrame:
    """Interleaves the rounds of a query: vouched prefixes first, then tails, then what was reached sideways.

    rounds: (q_id, part, rank, id, kind ranked|reached, cliff_at). A round without a cliff vouches for its first ``unvouched_first``.
    The first place of an id counts; returns (q_id, id, kind, rank).
    """
    vouched = F.col("rank") < F.coalesce("cliff_at", F.lit(unvouched_first))
    phase = F.when(F.col("kind") == "reached", 2).when(vouched, 0).otherwise(1)
    keyed = rounds.withColumn("phase", phase)
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("q_id", "id").orderBy("phase", "rank", "part"))).where("n = 1")
    return ranked(first.withColumnRenamed("rank", "pos"), "phase", "pos", "part", "id").select("q_id", "id", "kind", "rank")


def adjacent(art: DataFrame) -> DataFrame:
    """(id, before, after): the nearest active artifacts of the corpus on either side. Needs corpus_id, ordinal, status."""
    live = art.where(F.coalesce("status", F.lit("active")) == "active")
    w = Window.partitionBy("corpus_id").orderBy("ordinal", "id")
    return live.select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


def stitch(passages: DataFrame) -> DataFrame:
    """Joins passages that follow each other in one segment, where the hits hold both.

    Needs q_id, corpus_id, segment, start_line, end_line, rank, text. Returns (q_id, corpus_id, segment, head_rank, start_line, end_line, text).
    """
    w = Window.partitionBy("q_id", "corpus_id", "segment").orderBy("start_line", "rank")
    breaks = F.when(F.col("start_line") == F.lag("end_line").over(w) + 1, 0).otherwise(1)
    islands = passages.withColumn("__b", breaks).withColumn("__i", F.sum("__b").over(w))
    return (
        islands.groupBy("q_id", "corpus_id", "segment", "__i")
        .agg(
            F.min("rank").alias("head_rank"),
            F.min("start_line").alias("start_line"),
            F.max("end_line").alias("end_line"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "rank", "text"))), lambda x: x["text"]), "\n").alias("text"),
        )
        .drop("__i")
    )


def rerank(hits: DataFrame, scorer, top: int | None = None) -> DataFrame:
    """Ranks anew by ``scorer``, a column of the hits' own columns (a pandas UDF call fits); rows it gives null go to the end in their old order.

    Scores are rounded by the product with a power of ten, as SQL engines do it: a scorer that halves rounded scores makes halves of
    the last digit, and rounding the decimal text of such a double goes the other way in one case of a hundred.
    """
    unit = float(10**DIGITS)
    out = hits.withColumn("score", F.coalesce(F.round(scorer * unit) / unit, F.lit(float("-inf"))))
    return ranked(out.withColumnRenamed("rank", "old_rank"), F.desc("score"), F.asc("old_rank"), limit=top)


def overlap_scorer(query: str = "query", text: str = "text") -> Column:
    """Share of the query's terms that the text has: the default where no model is given."""
    q = F.array_distinct(lexical_tokens(F.col(query)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, lexical_tokens(F.col(text)))) / F.size(q)).otherwise(0.0)


def touch(points: DataFrame, touches: DataFrame) -> DataFrame:
    """Last seen and hit counts after touches (id, at, retrieved): only retrievals count as hits."""
    new = touches.groupBy("id").agg(F.max("at").alias("__at"), F.sum(F.col("retrieved").cast("long")).alias("__n"))
    joined = points.join(new, "id", "left")
    return joined.withColumn("last_seen_at", F.greatest("last_seen_at", "__at")).withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).drop("__at", "__n")
