"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints are one node. Distinct fingerprints, sorted by their number
of set bits and then by the set bits of each 16-bit quarter, are cut into tiles; two tiles
are compared only if the boxes of their quarters' bit counts come within the
radius, as fingerprints at d differing bits differ by at most d in the sum of those
counts. A comparison goes through blocks of a tile the same way, and does an
exclusive-or and a bit count in numpy for what is left. Each tile pair
returns a spanning forest of its links, so a dense group costs as many rows as it has members.

If links must also be similar, fingerprints are not all compared: sorted by each of four turns of their bits, those a few places apart
propose links, which is work in proportion to the rows. These are checked, and then what is across the parts they leave and shares shingles of both prefixes, as sets that are alike to the threshold must. A part meets a shingle as one row,
however many of its texts have it; two texts that are parts of their own are compared directly, and a part of several
is dealt in chunks, each compared with whole sets of those that met it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.common import buckets, byte_words, materialise, tidied
from loamwork.operators.graph import connected_components

SEED = 42
BLOCK = 128
#: Tiles that all fingerprints are cut into, as long as these are not too large.
TILES = 40
#: Texts sampled to find common shingles, at least and as a share of all, and how many of these every task knows.
SAMPLE, SHARE, COMMON = 5_000, 0.01, 50_000
#: Places that fingerprints are compared over, in each sorting that proposes links.
REACH = 4
#: Up to so many ends of links are broadcast.
FEW = 300_000
_QUARTERS = np.array([0, 16, 32, 48], np.uint64)
#: For each byte, its eight bits as the eight bytes of a word: sums of up to 255 of them don't overflow.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    """XXH64 of each run of ``size`` words, repeats included; of all words if there are fewer; none without words."""
    found = byte_words(text)
    if not found:
        return []
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(found))
    h = xxhash.xxh64_intdigest
    return [h(joined[a:b], SEED) for a, b in zip(starts[: len(found) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is set if it is set in over half the shingle hashes; 0 without words."""
    return majority(shingle_hashes(text, size))


def majority(hashes: list[int]) -> int:
    """A bit is set if it is set in over half the hashes."""
    if not hashes:
        return 0
    parts = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    totals = np.zeros(64, np.int64)
    for at in range(0, len(parts), 255):
        sums = np.ascontiguousarray(_SPREAD[parts[at : at + 255]].sum(axis=0, dtype=np.uint64))
        totals += sums.view(np.uint8)
    bits = np.packbits(totals * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return run


def quarters(fps: np.ndarray) -> np.ndarray:
    """Set bits of each 16-bit quarter, one row a fingerprint."""
    return np.bitwise_count((fps[:, None] >> _QUARTERS) & np.uint64(0xFFFF)).astype(np.int16)


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: sorted (place, fp); output: a row for each run of rows of one tile in this partition."""

    def out(tile: int, fps: np.ndarray) -> pa.RecordBatch:
        q = quarters(fps)
        total = q.sum(axis=1)
        cols = [
            pa.array([tile], pa.int64()),
            pa.array([int(total.min())], pa.int32()),
            pa.array([int(total.max())], pa.int32()),
            pa.array([q.min(axis=0).astype(np.int32).tolist()], pa.list_(pa.int32())),
            pa.array([q.max(axis=0).astype(np.int32).tolist()], pa.list_(pa.int32())),
            pa.array([fps.tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["tile", "low", "high", "box_low", "box_high", "fps"])

    held: list[np.ndarray] = []
    at = None
    for batch in batches:
        tiles, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.diff(tiles)) + 1
        for tile, part in zip(tiles[np.r_[0, cuts]] if len(tiles) else [], np.split(fps, cuts), strict=False):
            if at is not None and tile != at:
                yield out(int(at), np.concatenate(held))
                held = []
            at = tile
            held.append(part)
    if held:
        yield out(int(at), np.concatenate(held))


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    found = parent[at]
    while not (found == (up := parent[found])).all():
        found = up
    parent[at] = found
    return found


def _forest(parent: np.ndarray, u: np.ndarray, v: np.ndarray, links: list[tuple[int, int]]) -> None:
    """Joins the trees of linked places, each root to a smaller one of those it is linked to; appends the links that did so."""
    while len(u):
        one, two = _roots(parent, u), _roots(parent, v)
        fresh = one != two
        u, v, one, two = u[fresh], v[fresh], one[fresh], two[fresh]
        if not len(u):
            return
        low, high = np.minimum(one, two), np.maximum(one, two)
        hooked, at = np.unique(high, return_index=True)
        parent[hooked] = low[at]
        links += zip(u[at].tolist(), v[at].tolist(), strict=True)


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int, block: int = BLOCK) -> list[tuple[int, int]]:
    """A spanning forest of the links between (or, with ``b`` None, within) sorted tiles, as fingerprint pairs."""
    both = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    parent = np.arange(len(both))
    links: list[tuple[int, int]] = []
    right = a if b is None else b
    boxes = []
    for fps in (a, right):
        q = quarters(fps)
        starts = np.arange(0, len(fps), block)
        boxes.append((np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)))
    for i in range(len(boxes[0][0])):
        gap = np.maximum(0, np.maximum(boxes[0][0][i] - boxes[1][1], boxes[1][0] - boxes[0][1][i])).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if b is None:
            near = near[near >= i]
        if not len(near):
            continue
        left = a[i * block : (i + 1) * block]
        places = (near[:, None] * block + np.arange(block)).ravel()
        places = places[places < len(right)]
        for at in range(0, len(places), 4096):
            some = places[at : at + 4096]
            apart = np.bitwise_count(left[:, None] ^ right[some][None, :])
            u, v = np.nonzero(apart <= radius)
            if len(u) > 1:  # closest first, so a forest holds the surest links
                order = np.argsort(apart[u, v], kind="stable")
                u, v = u[order], v[order]
            u, v = u + i * block, some[v]
            if b is None:
                later = u < v
                u, v = u[later], v[later]
            if len(u):
                _forest(parent, u, v + shift, links)
    return [(int(both[u]), int(both[v])) for u, v in links]


def _compare(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two, x, y = (batch.column(c)[k].as_py() for c in range(4))
                a = np.frombuffer(x, np.uint64)
                found = close_pairs(a, None if one == two else np.frombuffer(y, np.uint64), radius)
                u = np.array([p for p, _ in found], np.uint64).view(np.int64)
                v = np.array([p for _, p in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def linked_fingerprints(prints: DataFrame, radius: int = 3, tile: int | None = None) -> DataFrame:
    """Links (u, v) that connect all of ``prints`` (distinct ``fp`` long) within ``radius`` bits, as a forest per tile pair.

    ``tile``: fingerprints a tile; by default a share of all, from 512 to 4 million (32 MB). It changes
    how the work is cut, never what is compared. Each tile is sent to the tasks of all its pairs, so fewer and larger ones
    mean less to send; within a pair, blocks of 128 are ruled out by their bit counts all the same.
    """
    n = prints.count()
    tile = tile or max(512, min(4_000_000, n // TILES))
    half = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    order = ["c", "q0", "q1", "q2", "q3", "fp"]
    sorted_prints = materialise(
        prints.select("fp", F.bit_count("fp").alias("c"), *[half(k).alias(f"q{k}") for k in range(4)])
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("fp", F.monotonically_increasing_id().alias("pos")),
        "simhash-sorted",
    )
    ranged = sorted_prints.withColumn("part", F.shiftright("pos", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition
    starts = (
        ranged.groupBy("part")
        .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    place = (F.col("pos") - F.col("first") + F.col("before")).cast("long")
    placed = ranged.join(F.broadcast(starts), "part").select(F.floor(place / tile).cast("long").alias("tile"), place.alias("place"), "fp")
    tiles = materialise(
        placed.repartition("tile")
        .sortWithinPartitions("tile", "place")
        .select("tile", "fp")
        .mapInArrow(_tile, "tile long, low int, high int, box_low array<int>, box_high array<int>, fps binary"),
        "simhash-tiles",
    )
    meta = tiles.drop("fps")
    # tiles meet in a shared value of the total count, widened by the radius on one side
    left = meta.select(F.col("tile").alias("a"), F.col("box_low").alias("al"), F.col("box_high").alias("ah"), F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("c"))
    right = meta.select(F.col("tile").alias("b"), F.col("box_low").alias("bl"), F.col("box_high").alias("bh"), F.explode(F.sequence("low", "high")).alias("c"))
    gap = F.aggregate(
        F.zip_with(F.zip_with("al", "bh", lambda x, y: x - y), F.zip_with("bl", "ah", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0))),
        F.lit(0),
        lambda s, x: s + x,
    )
    pairs = left.join(right, "c").where(F.col("a") <= F.col("b")).where(gap <= radius).select("a", "b").distinct()
    loaded = (
        pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("x")), "a")
        .join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    # spread over the cores by the pair, whatever the joins left together
    return loaded.repartition(F.col("a"), F.col("b")).mapInArrow(tidied(_compare(radius)), "u long, v long")


def _beside(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Input: (turn, turned) in order; output: a forest of the links of ``radius`` or fewer bits between rows up to ``REACH`` places apart, as the fingerprints they were before their turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, turned = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            turn = np.r_[turn[-REACH:], batch.column(0).to_numpy().astype(np.int64)]
            turned = np.r_[turned[-REACH:], batch.column(1).to_numpy().view(np.uint64)]
            u, v, bits = [], [], []
            for step in range(1, min(REACH, len(turned) - 1) + 1):
                apart = np.bitwise_count(turned[step:] ^ turned[:-step])
                at = np.flatnonzero((apart <= radius) & (turn[step:] == turn[:-step]))
                u.append(at)
                v.append(at + step)
                bits.append(apart[at])
            links: list[tuple[int, int]] = []
            if u:
                order = np.argsort(np.concatenate(bits), kind="stable")
                _forest(np.arange(len(turned)), np.concatenate(u)[order], np.concatenate(v)[order], links)
            back = (np.uint64(16) * turn.astype(np.uint64)) % np.uint64(64)
            fps = ((turned >> back) | (turned << ((np.uint64(64) - back) % np.uint64(64)))).view(np.int64)
            ends = fps[np.array(links, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["u", "v"])

    return run


def proposed_links(prints: DataFrame, radius: int) -> DataFrame:
    """Some links (u, v) of ``prints`` (distinct ``fp`` long, a written table) within ``radius`` bits, by work in proportion to the rows: of fingerprints that come near each other when sorted, after turns by 0, 16, 32 and 48 bits."""
    turn = lambda k: F.shiftleft("fp", 16 * k).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * k)) if k else F.col("fp")
    turns = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), turn(k).alias("turned")) for k in range(4)])).alias("t")
    rows = prints.select(turns).select("t.turn", "t.turned").repartitionByRange("turn", "turned").sortWithinPartitions("turn", "turned")
    return rows.mapInArrow(tidied(_beside(radius)), "u long, v long").distinct()


def jaccard(one: str | None, two: str | None, size: int) -> float:
    """Of the sets of shingles; 1 for two texts without words."""
    a, b = set(shingle_hashes(one, size)), set(shingle_hashes(two, size))
    return len(a & b) / len(a | b) if a or b else 1.0


def _alike(size: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(x.as_py(), y.as_py(), size) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(links: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """Those links (u, v) of nodes whose texts have a shingle similarity of ``least`` or more. nodes: (node, key); docs: (key, text)."""
    links = materialise(links, "simhash-links")
    ends = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    named = materialise(nodes.select("node", "key").join(ends, "node", "left_semi"), "simhash-ends")
    few = named.count() <= FEW  # spares a shuffle of all texts
    some = docs.join(F.broadcast(named) if few else named, "key").dropDuplicates(["node"])
    pairs = links.join(some.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(some.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
    return materialise(pairs.select("u", "v", "x", "y").mapInArrow(tidied(_alike(size, least)), "u long, v long"), "simhash-alike")


def prefix(shingles: np.ndarray, least: float, common: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, ``common`` ones last: two sets that are ``least`` alike share one of these."""
    if not len(shingles):
        return np.zeros(1, np.uint64)  # sets without shingles are alike
    usual = np.isin(shingles, common)
    return np.r_[shingles[~usual], shingles[usual]][: len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1]


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), size), np.uint64)) for t in batch.column(0)]
            for at in range(0, len(sets), 256):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets[at : at + 256]).view(np.int64))], ["token"])

    return run


def _prefixed(size: int, least: float, common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Input: (key, text); output: also the fingerprint, the size of the shingle set, and its prefix as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, blobs = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), size)
                whole = np.unique(np.array(hashes, np.uint64))
                fps.append(majority(hashes))
                sizes.append(len(whole))
                blobs.append(prefix(whole, least, common.value).tobytes())
            cols = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "fp", "n", "prefix"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: (n, prefix, part, fp); output: a row for each shingle of a prefix, ``place`` holding the set's size and the shingle's place."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            parts = [np.frombuffer(b.as_py(), np.int64) for b in batch.column(1)]
            sizes = np.array([len(x) for x in parts])
            pos = np.concatenate([np.arange(k) for k in sizes])
            place = (np.repeat(batch.column(0).to_numpy(), sizes) << 32) + pos
            same = [np.repeat(batch.column(k).to_numpy(), sizes) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(parts), place, *same)], ["token", "place", *batch.schema.names[2:]])


def _merged_rows(token: np.ndarray, place: np.ndarray, part: np.ndarray, fp: np.ndarray | None = None) -> list[np.ndarray]:
    """One row for each token and part, of tokens that several parts have: token, smallest and largest set, place (-1 for several rows), part, fingerprint; by token and smallest set."""
    order = np.lexsort((place, part, token))
    token, place, part = token[order], place[order], part[order]
    new = lambda *cols: np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)][: len(token)])
    first = new(token, part)
    if not len(first):
        return [np.zeros(0, np.int64)] * 6
    rows = np.diff(first, append=len(token))
    n = place >> 32
    low, high = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
    pos = np.where(rows == 1, place[first] & 0xFFFFFFFF, -1)
    token, part = token[first], part[first]
    fp = np.zeros(len(first), np.int64) if fp is None else fp[order][first]
    starts = new(token)
    met = np.diff(starts, append=len(token))
    shared = np.repeat(met > 1, met)
    out = [x[shared] for x in (token, low, high, pos, part, fp)]
    order = np.lexsort((out[1], out[0]))
    return [x[order] for x in out]


#: A token that more parts than this have is compared in blocks of so many, each pair of blocks by itself wherever there is room.
HOT = 2048
_PAIRS = "u long, v long, need long, left binary, right binary"


class _Shared:
    """Pairs of parts that share a token and may hold sets that are ``least`` alike, with how many shared tokens they need.

    radius: of two sets that are parts of their own, only those whose fingerprints are that close.
    """

    names = ["u", "v", "need", "left", "right"]

    def __init__(self, least: float, radius: int | None):
        self.least, self.radius = least, radius

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # what the larger set has behind its prefix can't hold more of the overlap than its size
        overlap = np.ceil(self.least / (1 + self.least) * (a + b) - 1e-6)
        return np.maximum(1, overlap - np.ceil(self.least * np.maximum(a, b) - 1e-9) + 1)

    def checked(self, one: list[np.ndarray], two: list[np.ndarray]) -> pa.RecordBatch | None:
        """Of rows side by side (low, high, pos, part, fp), the pairs that may do."""
        (low, high, pos, part, fp), (low2, high2, pos2, part2, fp2) = one, two
        alone = (pos >= 0) & (pos2 >= 0)
        # shared shingles in front of this one, this one, and those behind it
        most = np.minimum(pos, pos2) + np.minimum(low - pos, low2 - pos2)
        good = ~alone | (most >= np.ceil(self.least / (1 + self.least) * (low + low2) - 1e-6))
        if self.radius is not None:
            good &= ~alone | (np.bitwise_count((fp ^ fp2).view(np.uint64)) <= self.radius)
        good &= (part != part2) & (high >= self.least * low2 - 1e-6) & (high2 >= self.least * low - 1e-6)
        if not good.any():
            return None
        low, high, pos, part, low2, high2, pos2, part2 = (x[good] for x in (low, high, pos, part, low2, high2, pos2, part2))
        # of a part of several sizes, the smallest and the largest that can do need the fewest, or one more than those between them, as both numbers are rounded up
        a = np.where(pos >= 0, low, low2)
        least_b, most_b = np.where(pos >= 0, low2, low), np.where(pos >= 0, high2, high)
        first, last = np.maximum(least_b, np.floor(self.least * a)), np.minimum(most_b, np.ceil(a / self.least))
        some = np.maximum(1, np.minimum(self.needed(a, first), self.needed(a, last)) - (first < last))
        need = np.where((pos >= 0) | (pos2 >= 0), some, 1)
        cols = [pa.array(np.minimum(part, part2)), pa.array(np.maximum(part, part2)), pa.array(need.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(need), pa.binary())] * 2], self.names)

    def blocks(self, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks of one token's rows, to be compared later; blocks whose sizes are too far apart are left out."""
        cut = [[x[k : k + HOT] for x in rows] for k in range(0, len(rows[0]), HOT)]
        blobs = [b"".join(x.tobytes() for x in block) for block in cut]
        # smallest sets rise from block to block
        tops = [int(block[1].max()) for block in cut]
        for i in range(len(cut)):
            for j in range(i, len(cut)):
                if tops[i] >= self.least * int(cut[j][0][0]) - 1e-6:
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.array([blobs[i]], pa.binary()), pa.array([blobs[j]], pa.binary())], self.names)

    def pairs(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, *rows = _merged_rows(*cols)
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
        met = np.diff(starts, append=len(token))
        for at, n in zip(starts[met > HOT], met[met > HOT], strict=True):
            yield from self.blocks([x[at : at + n] for x in rows])
        usual = np.repeat(met <= HOT, met)
        token, rows = token[usual], [x[usual] for x in rows]
        at, step = np.arange(len(token)), 1
        while True:
            at = at[at < len(token) - step]
            # smallest sets rise within a token, so what is too small for one partner is so for all later ones
            at = at[(token[at] == token[at + step]) & (rows[1][at] >= self.least * rows[0][at + step] - 1e-6)]
            if not len(at):
                return
            if (found := self.checked([x[at] for x in rows], [x[at + step] for x in rows])) is not None:
                yield found
            step += 1

    def by_token(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input: rows of ``_tokens`` by token."""
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            other = np.flatnonzero(cols[0] != cols[0][-1])
            # the last token may go on in the next batch
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and held[-1][0][-1] == cols[0][-1] or not cut and not held:
                held.append(cols)
                continue
            held.append([c[:cut] for c in cols])
            yield from self.pairs(*map(np.concatenate, zip(*held, strict=True)))
            held = [[c[cut:] for c in cols]]
        if held:
            yield from self.pairs(*map(np.concatenate, zip(*held, strict=True)))

    def by_block(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input: pairs of blocks (left, right)."""
        for batch in batches:
            for left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = (np.frombuffer(b, np.int64).reshape(5, -1) for b in (left, right))
                for k in range(0, one.shape[1], 64):
                    part = one[:, k : k + 64]
                    i, j = np.meshgrid(np.arange(part.shape[1]), np.arange(two.shape[1]), indexing="ij")
                    once = (i + k < j).ravel() if left == right else np.ones(i.size, bool)
                    i, j = i.ravel()[once], j.ravel()[once]
                    if (found := self.checked([x[i] for x in part], [x[j] for x in two])) is not None:
                        yield found.select(["u", "v", "need"])


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that a sample of the texts repeats, a share of all so that what is left out is met by few texts however many there are. They come last in the order, which saves work and loses no pair."""
    n = docs.count()
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(3)), 11) / float(1 << 53)
    sample = docs.where(draw < F.lit(min(1.0, max(SHARE, SAMPLE / max(1, n))))).select("text").distinct().mapInArrow(_sets(size), "token long")
    often = sample.groupBy("token").count().where("count >= 5").orderBy(F.desc("count"), "token").limit(COMMON).collect()
    return np.array([r.token for r in often], np.int64).view(np.uint64)


def met_parts(nodes: DataFrame, least: float, radius: int | None) -> DataFrame:
    """Pairs of parts (u, v) of which a set of each may be ``least`` alike, by the shingles that such sets must share.

    nodes: (part, fp, n, prefix). With ``radius``, of two sets that are parts of their own only those whose fingerprints are that close.
    """
    names = ["part"] + ["fp"] * (radius is not None)
    tokens = nodes.select("n", "prefix", *names).mapInArrow(tidied(_tokens), ", ".join(f"{c} long" for c in ["token", "place", *names]))
    pairs = _Shared(least, radius)
    found = materialise(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(tidied(pairs.by_token), _PAIRS), "simhash-shared")
    late = found.where("left is not null").select("left", "right").repartition(buckets(found.where("left is not null"), 8))
    shared = found.where("left is null").select("u", "v", "need").unionByName(late.mapInArrow(tidied(pairs.by_block), "u long, v long, need long"))
    counted = shared.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("need"))
    return counted.where("k >= need").select("u", "v")


def _within(size: int, least: float, radius: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Input: (base, chunk, salt, side, node, fp, text) by the first four; the members of a chunk (side 0) come before those that ask (side 1). Output: a link of each that has one."""

    class Chunk:
        def __init__(self, key):
            self.key, self.nodes, self.fps, self.sets = key, [], [], []
            self.built = None

        def build(self):
            sizes = np.array([len(x) for x in self.sets], np.int64)
            whole, owner = np.concatenate(self.sets), np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(whole, kind="stable")
            self.built = whole[order], owner[order], sizes, np.array(self.fps, np.int64)

        def alike(self, own: np.ndarray, fp: int) -> int | None:
            if self.built is None:
                self.build()
            whole, owner, sizes, fps = self.built
            a, b = np.searchsorted(whole, own, "left"), np.searchsorted(whole, own, "right")
            n = b - a
            at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(own) else np.zeros(0, np.int64)
            both = np.bincount(owner[at], minlength=len(sizes))
            either = len(own) + sizes - both
            good = np.where(either > 0, both / np.maximum(either, 1), 1.0) >= least
            if radius is not None:
                good &= np.bitwise_count((fps ^ fp).view(np.uint64)) <= radius
            found = np.flatnonzero(good)
            return self.nodes[found[0]] if len(found) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = None
        for batch in batches:
            links = []
            for *key, side, node, fp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk is None or chunk.key != key:
                    chunk = Chunk(key)
                own = np.unique(np.array(shingle_hashes(text, size), np.uint64))
                if not side:
                    chunk.nodes.append(node)
                    chunk.fps.append(fp)
                    chunk.sets.append(own)
                elif chunk.nodes and (other := chunk.alike(own, fp)) is not None:
                    links.append((node, other))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], pa.int64()), pa.array([v for _, v in links], pa.int64())], ["u", "v"])

    return run


def missed_links(nodes: DataFrame, docs: DataFrame, size: int, least: float, radius: int | None, members: int = 512, askers: int = 512) -> DataFrame:
    """Links (u, v) of nodes in different parts whose texts are ``least`` alike: of all pairs of parts that have such a link, one at least.

    nodes: (node, key, part, fp, n, prefix); docs: (key, text). Of two parts the smaller one's texts ask; the larger one's are cut into chunks of
    about ``members``, and each chunk's askers are dealt to tasks of about ``askers``, so neither side is ever gathered.
    """
    parts = materialise(nodes.select("node", "key", "part", "fp"), "simhash-parts")
    met = materialise(met_parts(nodes, least, radius), "simhash-met")
    several = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = met.join(several.select(F.col("part").alias("u"), F.col("size").alias("su")), "u", "left").join(several.select(F.col("part").alias("v"), F.col("size").alias("sv")), "v", "left")
    # a part of its own has the number of its node
    sized = materialise(sized, "simhash-met-sizes")
    alone = verified(sized.where("su is null and sv is null").select("u", "v"), parts, docs, size, least)
    su, sv = F.coalesce("su", F.lit(1)), F.coalesce("sv", F.lit(1))
    asked = sized.where("su is not null or sv is not null").select(
        F.when(su < sv, F.col("u")).otherwise(F.col("v")).alias("asker"), F.when(su < sv, F.col("v")).otherwise(F.col("u")).alias("base"), F.greatest(su, sv).alias("size")
    )
    asking = asked.join(parts.select(F.col("part").alias("asker"), "node", "fp"), "asker")
    counts = asking.groupBy("base").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    dealt = materialise(counts.select("base", F.ceil(F.col("size") / members).cast("int").alias("chunks"), F.ceil(F.col("n") / askers).cast("int").alias("salts")), "simhash-bases")
    of = lambda c, n: F.pmod(F.xxhash64(F.col(c), F.lit(17)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = parts.join(dealt, parts.part == dealt.base).select("base", of("node", "chunks").alias("chunk"), every("salts").alias("salt"), F.lit(0).alias("side"), "node", "fp")
    ask = asking.join(dealt, "base").select("base", every("chunks").alias("chunk"), of("node", "salts").alias("salt"), F.lit(1).alias("side"), "node", "fp")
    rows = materialise(held.unionByName(ask), "simhash-chunks")
    wanted = rows.select("node").distinct().join(parts.select("node", "key"), "node")
    texts = docs.join(wanted, "key").dropDuplicates(["node"]).select("node", "text")
    by = ["base", "chunk", "salt"]
    sorted_rows = rows.join(texts, "node").select(*by, "side", "node", "fp", "text").repartition(*by).sortWithinPartitions(*by, "side")
    return alone.unionByName(sorted_rows.mapInArrow(tidied(_within(size, least, radius)), "u long, v long"))


def similar_rows(docs: DataFrame, size: int, radius: int, least: float, beyond: bool) -> DataFrame:
    """(id, key, fp, part) of every row of ``docs`` (id, text), written: the MD5 of its text, its fingerprint and a number of its group, as ``simhash_dedup`` with ``least`` links them. A node is a distinct text."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select(F.md5("text").alias("key"), "text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))
    prints = keyed.mapInArrow(tidied(_prefixed(size, least, common)), "key string, fp long, n long, prefix binary").dropDuplicates(["key"])
    nodes = materialise(prints.withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    firsts = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")), "simhash-prints")
    close = proposed_links(firsts.select("fp"), radius)
    named = close.join(firsts.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(firsts.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    equal = nodes.select("node", "fp").join(firsts, "fp").where("node <> first").select("first", "node")
    links = verified(named.select(F.col("a").alias("u"), F.col("b").alias("v")).union(equal), nodes, keyed, size, least)
    # the links so far are some of those there are: all that could join two parts are checked
    part = F.coalesce("component", "node").alias("part")
    marked = nodes.join(connected_components(links), "node", "left").select("node", "key", part, "fp", "n", "prefix")
    more = missed_links(marked, keyed, size, least, None if beyond else radius)
    root = nodes.select("node", "key", "fp").join(connected_components(links.union(more)), "node", "left").select("key", "fp", part)
    return materialise(docs.select("id", F.md5("text").alias("key")).join(root, "key").select("id", "key", "fp", "part"), "simhash-rows")


def similar_firsts(docs: DataFrame, size: int, radius: int, least: float) -> DataFrame:
    """(id, key) of one row of each group of texts that are ``least`` alike: of the smallest id, and the smallest MD5 of a text among its texts. A null id comes last."""
    rows = similar_rows(docs, size, radius, least, beyond=True)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    return rows.groupBy("part").agg(first).select("first.id", "first.key")


def similar_dedup(docs: DataFrame, size: int, radius: int, least: float, beyond: bool) -> DataFrame:
    """(id, fp, component_id) of every row of ``docs`` (id, text): see ``simhash_dedup`` with ``least``."""
    rows = similar_rows(docs, size, radius, least, beyond).select("id", "fp", "part")
    return rows.join(rows.groupBy("part").agg(F.min("id").alias("component_id")), "part").select("id", "fp", "component_id")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, tile: int | None = None, least: float | None = None, beyond: bool = False
) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id that links of ``radius`` or fewer differing bits
    reach, the row's own included. Null texts and texts without words have fingerprint zero, which is
    linked like any other. Null ids keep their row; a component of null ids alone has a null
    ``component_id``. Ids are integers, other types are refused. Repeated rows come out as often as they went in; an empty table gives no rows.

    With ``least``, a link also needs that similarity of the two texts' shingle sets, equal fingerprints included;
    with ``beyond``, that similarity alone makes a link, however far the fingerprints are apart. No such link is lost.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer column")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    if least is not None:
        source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        of = similar_dedup(source, size, radius, least, beyond)
        return of.select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
    prints = materialise(
        docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_fingerprints(size), "id long, fp long"), "simhash-prints"
    )
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    links = linked_fingerprints(nodes.select("fp"), radius, tile)
    joined = connected_components(links)
    root = nodes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )
    smallest = root.groupBy("root").agg(F.min("first").alias("component_id"))
    of = root.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
