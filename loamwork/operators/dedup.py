"""Capture-time duplicates, near-duplicates by signature, pairs, keepers, lineage."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.digests import md5_heads
from loamwork.functions.text import normal_query
from loamwork.operators.dealing import sliced
from loamwork.operators.graph import connected_components
from loamwork.storage import discard, materialise

K, LEAST = 128, 0.90
BLOCK = 1024


def first_of_content(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, content_hash, first_id, is_first, copies) by SHA-256 of the text. The copies of one text are reduced before they meet, not gathered."""
    hashed = docs.select("id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(groups, "content_hash").select("id", "content_hash", "first_id", (F.col("id") == F.col("first_id")).alias("is_first"), "copies")


def insert_new(table: DataFrame, new: DataFrame, key: str = "content_hash") -> DataFrame:
    """The table with those new rows whose key it lacks; of new rows with one key, the smallest id."""
    fresh = new.join(table.select(key), key, "left_anti")
    w = Window.partitionBy(key).orderBy("id")
    return table.unionByName(fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*table.columns))


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def signatures(docs: DataFrame, size: int = 5, k: int = K, text: str = "text") -> DataFrame:
    """(id, sig): the bottom-k MinHash of ``functions.text.signature`` for every document, in one Arrow pass."""

    def of(value: str | None) -> list[str]:
        w = _WORDS.findall((value or "").lower())
        found = {hashlib.md5(" ".join(w[a : a + size]).encode("utf-8", "surrogatepass")).hexdigest() for a in range(max(1, len(w) - size + 1))} if w else set()
        return heapq.nsmallest(k, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.list_(pa.string()))], ["id", "sig"])

    return docs.select("id", text).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, sig array<string>")


def _packed(size: int, k: int):
    """(id, sig): the same hashes by their first eight bytes, which keep their order, as one run of bytes."""

    def of(texts: list[str | None]) -> list[bytes]:
        words = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]
        flat = [w for own in words for w in own]
        counts = np.array([len(own) for own in words])
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        ends = np.cumsum(lengths + 1) - 1
        after = np.cumsum(counts)
        runs = np.where(counts > 0, np.maximum(1, counts - size + 1), 0)
        upto = np.cumsum(runs)
        first = np.arange(runs.sum()) + np.repeat(after - counts - (upto - runs), runs)
        last = np.minimum(first + size, np.repeat(after, runs)) - 1
        starts = (ends - lengths)[first]
        hashes = md5_heads(b" ".join(flat), starts, ends[last] - starts)
        return [_distinct(own)[:k].astype(">u8").tobytes() for own in np.split(hashes, upto[:-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch.column(1).to_pylist()), pa.binary())], ["id", "sig"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, most: int = K) -> float:
    """Jaccard estimate over the bottom k of the union of two ascending signatures."""
    k = min(most, len(a), len(b))
    if not k:
        return 0.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return int((shared <= np.union1d(a, b)[k - 1]).sum()) / k


class _Block:
    """Nodes of one block and their signatures, also end to end with their owners."""

    def __init__(self, listed: pa.Scalar):
        self.reps = listed.values.field("rep").to_numpy()
        self.sigs = [np.frombuffer(s.as_buffer(), ">u8").astype(np.uint64) for s in listed.values.field("sig")]
        self.sizes = np.array([len(s) for s in self.sigs])
        self.whole, self.owner = np.concatenate(self.sigs), np.repeat(np.arange(len(self.sigs)), self.sizes)

    def marks(self, hashes: np.ndarray) -> np.ndarray:
        """Which nodes have which of some ascending hashes, as ones and zeros."""
        at = np.searchsorted(hashes, self.whole)
        at[at == len(hashes)] = 0
        there = hashes[at] == self.whole
        out = np.zeros((len(self.sigs), len(hashes)), np.float32)
        out[self.owner[there], at[there]] = 1
        return out


def _distinct(hashes: np.ndarray, least: int = 1) -> np.ndarray:
    """Those that come ``least`` times, ascending."""
    hashes = np.sort(hashes)
    firsts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    return hashes[firsts[np.diff(firsts, append=len(hashes)) >= least]]


def _may_be_alike(left: _Block, right: _Block, least: float, step: int = 4096) -> np.ndarray:
    """(p, q) of nodes that share enough hashes at all, ascending. Only hashes that meet are counted, as a product of matrices."""
    met = _distinct(left.whole, 2) if left is right else np.intersect1d(_distinct(left.whole), _distinct(right.whole), assume_unique=True)
    shared = np.zeros((len(left.sigs), len(right.sigs)), np.float32)
    for k in range(0, len(met), step):
        marks = left.marks(met[k : k + step])
        shared += marks @ (marks if left is right else right.marks(met[k : k + step])).T
    return np.argwhere(shared >= least * np.minimum(K, np.minimum(left.sizes[:, None], right.sizes)) - 1e-9)


def _links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, x, y in zip(*(batch.column(c) for c in ("i", "j", "x", "y")), strict=True):
                parent: dict[int, int] = {}

                def top(v: int, parent: dict[int, int] = parent) -> int:
                    while parent.setdefault(v, v) != v:
                        v = parent[v]
                    return v

                left, same, out = _Block(x), one.as_py() == two.as_py(), []
                right = left if same else _Block(y)
                for p, q in _may_be_alike(left, right, least).tolist():
                    if same and q <= p:
                        continue
                    rep, other = int(left.reps[p]), int(right.reps[q])
                    if top(rep) != top(other) and estimate(left.sigs[p], right.sigs[q]) >= least:
                        parent[top(rep)] = top(other)
                        out.append((rep, other))
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["u", "v"])

    return run


def _first_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: (rep, sig, reach); output: a row for each of the first ``reach`` hashes."""
    for batch in batches:
        sigs = [np.frombuffer(s.as_buffer(), ">i8")[:n].astype(np.int64) for s, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
        rep = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sigs])
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64))], ["rep", "h"])


def near_duplicates(docs: DataFrame, least: float = LEAST, size: int = 5, text: str = "text") -> DataFrame:
    """(id, class_id): classes that signature similarity of ``least`` or more links, class_id the smallest id; every row is returned.

    Texts with one signature are one node. A pair at ``least`` shares one of the first few hashes of
    both signatures, so nodes meet only there: which hashes several have is found out on (node, hash) alone, and only there do signatures go, once for hashes that the same nodes share. A hash that many
    share is cut into blocks whose pairs of blocks are separate rows, each returning a spanning forest of its links. Needs integer ids; documents without words link to nothing.
    """
    kind = docs.schema["id"].dataType.simpleString()
    raw = materialise(docs.select("id", text).mapInArrow(_packed(size, K), f"id {kind}, sig binary").withColumn("key", F.md5("sig")), "near-signatures")
    nodes = materialise(raw.where(F.octet_length("sig") > 0).groupBy("key").agg(F.min("id").cast("long").alias("rep"), F.first("sig").alias("sig")), "near-nodes")
    signed = materialise(raw.select("id", "key"), "near-keys")
    discard(raw)
    reach = F.floor(F.least(F.lit(K), F.octet_length("sig") / 8) * (1 - least) + 1e-9).cast("int") + 1
    met = nodes.select("rep", "sig", reach.alias("reach")).mapInArrow(_first_hashes, "rep long, h long")
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    shared = met.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1")
    counts = shared.groupBy("n", "m1", "m2").agg(F.min("h").alias("h")).select("h", "n")
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = met.join(counts, "h").withColumn("blocks", n_blocks).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    blocks = dealt.join(nodes.select("rep", "sig"), "rep").groupBy("h", "blocks", "i").agg(F.collect_list(F.struct("rep", "sig")).alias("x"))
    blocks = materialise(blocks, "near-blocks")
    # a block meets itself where it lies, and the later ones of its hash by numbers that are exploded, not by pairs of rows
    own = blocks.select("i", F.col("i").alias("j"), "x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))
    left = blocks.where("i < blocks - 1").select("h", "i", "x", F.explode(F.sequence(F.col("i") + 1, F.col("blocks") - 1)).alias("j"))
    right = blocks.where("i > 0").select("h", F.col("i").alias("j"), F.col("x").alias("y"))
    # dealt anew by what names the pair of blocks, as one shingle's pairs would stay together
    across = left.join(right, ["h", "j"]).repartition("h", "i", "j").select("i", "j", "x", "y")
    found = [t.mapInArrow(_links(least), "u long, v long") for t in (own, across)]
    links = materialise(found[0].unionByName(found[1]), "near-links")
    discard(blocks)
    of = connected_components(links)
    roots = nodes.join(of, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("class_id"))
    return signed.select("id", "key").join(roots, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def capture(corpora: DataFrame, new: DataFrame) -> DataFrame:
    """What becomes of captured texts: blank ones are rejected, known hashes are duplicates, near ones wait for review, others are queued.

    corpora: (id, text, content_hash); new: (id, text), ids above all known ones.
    """
    hashed = new.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("blank", normal_query(F.coalesce("text", F.lit(""))) == "")
    w = Window.partitionBy("content_hash").orderBy("id")
    seen = hashed.join(corpora.select("content_hash", F.lit(True).alias("known")).distinct(), "content_hash", "left").withColumn("again", F.col("known").isNotNull() | (F.row_number().over(w) > 1))
    near = near_duplicates(corpora.select("id", "text").unionByName(new.select("id", "text")))
    status = (
        F.when(F.col("blank"), "rejected").when(F.col("again"), "duplicate").when(F.col("class_id") < F.col("id"), "needs_review").otherwise("queued")
    )
    return seen.join(near, "id").select("id", status.alias("status"), F.when((status == "needs_review"), F.col("class_id")).alias("near_id"))


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Smaller id first, one row a pair with its best score, no pair of a thing with itself."""
    ordered = pairs.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "score")
    return ordered.where("a_id <> b_id").groupBy("a_id", "b_id").agg(F.max("score").alias("score"))


def repoint_pairs(pairs: DataFrame, moved: DataFrame) -> DataFrame:
    """Open pairs after merges (old_id, new_id): ends move, pairs within a merge and second copies go."""
    a, b = moved.select(F.col("old_id").alias("a_id"), F.col("new_id").alias("na")), moved.select(F.col("old_id").alias("b_id"), F.col("new_id").alias("nb"))
    after = pairs.join(a, "a_id", "left").join(b, "b_id", "left")
    return canonical_pairs(after.select(F.coalesce("na", "a_id").alias("a_id"), F.coalesce("nb", "b_id").alias("b_id"), "score"))


def keepers(pairs: DataFrame, art: DataFrame) -> DataFrame:
    """(id, keeper_id, superseded): of each cluster of pairs (a_id, b_id), the newest artifact (id, created_at) stays, the larger id of equals."""
    of = connected_components(pairs.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    members = of.join(art.select(F.col("id").alias("node"), "created_at"), "node")
    best = members.groupBy("component").agg(F.max(F.struct("created_at", "node")).alias("k"))
    return members.join(best, "component").select(F.col("node").alias("id"), F.col("k.node").alias("keeper_id"), (F.col("node") != F.col("k.node")).alias("superseded"))


def closed_pairs(pairs: DataFrame, art: DataFrame) -> DataFrame:
    """State of filed pairs by what lives: both ends pending, one superseded by the other settled, else dismissed. art: (id, status, superseded_by)."""
    side = lambda p: art.select(F.col("id").alias(f"{p}_id"), F.coalesce("status", F.lit("active")).alias(f"{p}_status"), F.col("superseded_by").alias(f"{p}_by"))
    both = pairs.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    live = (F.col("a_status") == "active") & F.col("a_by").isNull() & (F.col("b_status") == "active") & F.col("b_by").isNull()
    settled = F.col("a_by").eqNullSafe(F.col("b_id")) | F.col("b_by").eqNullSafe(F.col("a_id"))
    return both.select("a_id", "b_id", F.when(live, "pending").when(settled, "settled").otherwise("dismissed").alias("state"))


def classify_pairs(pairs: DataFrame, art: DataFrame) -> DataFrame:
    """What to do with close pairs (a_id, b_id, score): skip those of one window, supersede a text the other contains, file the rest. art: (id, segment, text)."""
    side = lambda p: art.select(F.col("id").alias(f"{p}_id"), F.col("segment").alias(f"{p}_segment"), normal_query(F.coalesce("text", F.lit(""))).alias(f"{p}_text"))
    both = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    a_in_b = (F.col("a_text") != "") & F.contains("b_text", "a_text")
    b_in_a = (F.col("b_text") != "") & F.contains("a_text", "b_text")
    shorter = F.when(b_in_a, F.col("b_id")).when(a_in_b, F.col("a_id"))
    same = F.coalesce(F.col("a_segment") == F.col("b_segment"), F.lit(False))
    action = F.when(same, "skip").when(shorter.isNotNull(), "supersede").otherwise("file")
    return both.select("a_id", "b_id", "score", action.alias("action"), F.when(action == "supersede", shorter).alias("obsolete_id"))


def lineage(sources: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """(root, node, parent, depth): sources of sources of each asked artifact, shortest way first; cycles end where they close.

    sources: (child_id, root_id); roots: (id). One join a level, ``depth`` levels at most.
    """
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(None).cast(roots.schema["id"].dataType).alias("parent"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        step = front.select("root", F.col("node").alias("child_id")).join(sources.select("child_id", "root_id"), "child_id")
        fresh = step.groupBy("root", F.col("root_id").alias("node")).agg(F.min("child_id").alias("parent")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = materialise(fresh.select("root", "node", "parent", F.lit(d).alias("depth")), "lineage")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def origins(art: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, corpora): a merge's origins are its roots' corpora; one without roots has none; other artifacts have their own."""
    own = art.select(F.col("id").alias("root_id"), F.col("corpus_id").alias("c"))
    drawn = sources.select(F.col("child_id").alias("id"), "root_id").join(own, "root_id").groupBy("id").agg(F.array_sort(F.collect_set("c")).alias("of"))
    written = F.col("provenance").isin("merged", "synthesized")
    alone = F.when(written, F.array().cast(f"array<{art.schema['corpus_id'].dataType.simpleString()}>")).otherwise(F.array_compact(F.array("corpus_id")))
    return art.join(drawn, "id", "left").select("id", F.coalesce("of", alone).alias("corpora"))


def merge_losses(drafts: DataFrame) -> DataFrame:
    """(draft_id, lost): facts and literals of the roots' texts that a draft lacks. drafts: (draft_id, draft, roots array<string>)."""
    from loamwork.functions.text import fact_tokens, literals, missing

    whole = F.array_join("roots", "\n")
    facts = F.array_except(fact_tokens(whole), fact_tokens(F.col("draft")))
    return drafts.select("draft_id", F.array_sort(F.array_union(facts, missing(literals(whole), F.col("draft")))).alias("lost"))


def drift(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(id, side): ids that only one of two stores has."""
    a, b = rows.select("id"), points.select("id")
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("no_point")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("no_row")))
