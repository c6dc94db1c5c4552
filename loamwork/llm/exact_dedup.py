"""Exact de-duplication with a log-structured index of text digests.

1. Each map task keeps a memtable of the texts it has met, by SHA-256 of the
   normalised text; equal bytes share an entry. A full memtable is flushed as a
   sorted run of entries (digest, the ids of its rows, their smallest), so a text that
   a third of all rows repeat makes one entry per memtable, not one per row.
2. Entries are dealt by digest to as many buckets as their number asks for, so that a bucket's runs fit its task. Each bucket's task runs a ``LogIndex``:
   sorted runs with Bloom filters, compacted to the smallest identifier per digest.
3. Digests with several entries are hits. Each hit's bytes are compared with
   those of the entry that the index names; entries of other bytes under the
   same digest (a collision) form groups of their own by text. A filter over the shared digests,
   of a fixed largest size, keeps the texts of other entries out of that shuffle; as it
   fills up, more texts pass than need to, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import WS_CLASS, buckets, materialise
from loamwork.llm.runs import Bloom, LogIndex

LAST = np.iinfo(np.int64).max
PAYLOAD = np.dtype([("id", "i8"), ("entry", "i8"), ("rows", "i8"), ("entries", "i8")])


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", " ")


def keep_smallest(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = old.copy()
    less = (new["id"] < old["id"]) | ((new["id"] == old["id"]) & (new["entry"] < old["entry"]))
    out["id"][less], out["entry"][less] = new["id"][less], new["entry"][less]
    out["rows"] += new["rows"]
    out["entries"] += new["entries"]
    return out


def _memtable(rows: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(table: dict, seq: int, part: int) -> tuple[pa.RecordBatch, int]:
        found = sorted(((d, t, ids) for d, variants in table.items() for t, ids in variants), key=lambda x: x[0])
        ids = [sorted(x[2]) for x in found]
        cols = [
            pa.array([x[0] for x in found], pa.binary()),
            pa.array(range((part << 40) + seq, (part << 40) + seq + len(found)), pa.int64()),
            pa.array([[None if i == LAST else i for i in x] for x in ids], pa.list_(pa.int64())),
            pa.array([x[0] for x in ids], pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([x[1] for x in found], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["digest", "entry", "ids", "min_id", "n", "text"]), seq + len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        n = held = seq = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, digests, texts = (batch.column(k) for k in range(3))
            for i, digest, text in zip(ids.to_pylist(), digests.to_pylist(), texts, strict=True):
                variants = table.setdefault(digest, [])
                text = text.as_py()
                for known, of in variants:
                    if known == text:
                        of.append(LAST if i is None else i)
                        break
                else:
                    variants.append((text, [LAST if i is None else i]))
                    held += len(text)
                n += 1
                if n >= rows or held >= size:
                    out, seq = flush(table, seq, part)
                    table, n, held = {}, 0, 0
                    yield out
        if table:
            yield flush(table, seq, part)[0]

    return run


def _bucket(width: int, memtable: int, fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LogIndex(width, PAYLOAD, keep_smallest, memtable, fanout)
        for batch in batches:
            payload = np.zeros(batch.num_rows, PAYLOAD)
            for k, name in enumerate(("entry", "min_id", "n"), 1):
                payload[{"min_id": "id", "n": "rows"}.get(name, name)] = batch.column(k).to_numpy(zero_copy_only=False)
            payload["entries"] = 1
            index.add(np.array(batch.column(0).to_pylist(), index.kind), payload)
        keys, payload = index.compacted()
        for at in range(0, len(keys), 50_000):
            k, p = keys[at : at + 50_000], payload[at : at + 50_000]
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(k), [None, pa.py_buffer(k.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [fixed.cast(pa.binary()), pa.array(p["entry"]), pa.array(p["entries"])], ["digest", "keep_entry", "entries"]
            )

    return run


SEGMENTS = 256


def _filter_of(shared: DataFrame, largest_bytes: int) -> tuple[bytes, int]:
    """Filters over the digests of ``shared``, one for each first byte, end to end; bits of each."""
    size = max(64, min(largest_bytes * 8, shared.count() * 16) // SEGMENTS // 8 * 8)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Bloom] = {}
        for batch in batches:
            for segment, keys in _by_segment(batch.column(0)):
                bloom = Bloom(keys[1], size=size)
                if segment in held:
                    held[segment].bits |= bloom.bits
                else:
                    held[segment] = bloom
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([b.bits.tobytes() for b in held.values()], pa.binary())], ["segment", "bits"]
        )

    dealt = shared.select("digest").repartition(F.substring(F.hex("digest"), 1, 2))
    found = {r.segment: bytes(r.bits) for r in dealt.mapInArrow(build, "segment int, bits binary").toLocalIterator()}
    return b"".join(found.get(k, bytes(size // 8 + 1)) for k in range(SEGMENTS)), size


def _by_segment(digests: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(first byte, (places, digests)) of a column."""
    raw = digests.to_pylist()
    if not raw:
        return
    keys = np.array(raw, f"S{len(raw[0])}")
    first = keys.view(np.uint8).reshape(len(keys), -1)[:, 0]
    for segment in np.unique(first).tolist():
        places = np.flatnonzero(first == segment)
        yield segment, (places, keys[places])


def _sift(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = shared.value
        width = size // 8 + 1
        for batch in batches:
            passed = np.zeros(batch.num_rows, bool)
            for segment, (places, keys) in _by_segment(batch.column(0)):
                own = np.frombuffer(bits, np.uint8, width, segment * width)
                passed[places] = Bloom.of(own, size).maybe(keys)
            yield batch.filter(pa.array(passed))

    return run


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = lambda text: F.unhex(F.sha2(text, 256)),
    width: int = 32,
    memtable_rows: int = 50_000,
    memtable_chars: int = 16_000_000,
    index_memtable: int = 200_000,
    fanout: int = 4,
    filter_bytes: int = 32_000_000,
) -> DataFrame:
    """Which row stays of each group of equal texts: one row per input row.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.
    Texts are equal when identical after each run of white space became one
    space; null counts as empty. The row with the smallest id stays; null ids
    come last (a group of null ids alone has a null ``keep_id``), and of rows that
    repeat the smallest id just one is kept. Empty tables give no rows; other columns are not read. ``digest``
    yields ``width`` bytes; it decides only where a text is looked for, as bytes are compared. Ids are integers, or numbers as text.
    """
    text = normalised(F.col(text_col))
    source = docs.select(F.col(id_col).cast("long").alias("id"), digest(text).alias("digest"), text.alias("text"))
    entries = materialise(
        source.mapInArrow(
            _memtable(memtable_rows, memtable_chars),
            "digest binary, entry long, ids array<long>, min_id long, n long, text string",
        ),
        "exact-dedup-runs",
    )
    index = (
        entries.select("digest", "entry", "min_id", "n")
        .repartition(buckets(entries), "digest")
        .mapInArrow(_bucket(width, index_memtable, fanout), "digest binary, keep_entry long, entries long")
    )
    shared = materialise(index.where("entries > 1").drop("entries"), "exact-dedup-shared")
    sift = docs.sparkSession.sparkContext.broadcast(_filter_of(shared, filter_bytes))
    told = entries.select("digest", "entry", "min_id", "n", "text")
    hits = materialise(told.mapInArrow(_sift(sift), told.schema).join(shared, "digest"), "exact-dedup-hits")
    named = hits.where("entry = keep_entry").select("digest", F.col("text").alias("named_text"))
    # null for the bytes that the index names, else the text itself
    checked = hits.join(named, "digest").select(
        "digest", "entry", "min_id", "n", F.when(F.col("text") != F.col("named_text"), F.col("text")).alias("other")
    )
    groups = checked.groupBy("digest", "other").agg(
        F.min(F.struct("min_id", "entry")).alias("first"), F.sum("n").alias("size")
    )
    same = (F.col("c.digest") == F.col("g.digest")) & F.col("c.other").eqNullSafe(F.col("g.other"))
    resolved = checked.alias("c").join(groups.alias("g"), same).select("c.entry", "g.first", "g.size")
    keep_id = F.coalesce(F.col("first.min_id"), F.col("min_id"))
    is_first = F.coalesce(F.col("first.entry"), F.col("entry")) == F.col("entry")
    return (
        entries.select("entry", "ids", "min_id", "n", F.sha2("text", 256).alias("text_sha256"))
        .join(resolved, "entry", "left")
        .select(
            F.posexplode("ids").alias("pos", id_col),
            F.when(keep_id != F.lit(int(LAST)), keep_id).alias("keep_id"),
            F.coalesce("size", "n").cast("long").alias("group_size"),
            is_first.alias("__first"),
            "text_sha256",
        )
        .select(id_col, "keep_id", "group_size", (F.col("__first") & (F.col("pos") == 0)).alias("kept"), "text_sha256")
    )
