"""Removal of lines that many documents share, by levelled runs of line hashes.

A line's key is the line stripped of white space at both ends with A-Z lowered;
its hash is 128 bits of XXH3. First pass: map tasks reduce batches of documents
to (hash, documents that hold it); these are written and dealt by hash to as many buckets as their number asks for, and each bucket's
task feeds them to a ``RunIndex``: every batch is sorted, merge-anti-joined with the
levelled runs (known hashes add to the counts there), and what is new becomes a run of its own; levels are compacted
as they fill. Second pass: documents lose the lines whose hash reached the limit.

The frequent hashes go to the map tasks as one string of bytes, which they make a set of, while they fit
``broadcast_hashes``; beyond that, each document's hashes are joined with them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.common import WS, ascii_lower_text, buckets, materialise, tidied
from loamwork.llm.runs import RunIndex

WIDTH = 16
PAYLOAD = np.dtype([("docs", "i8")])


def line_key(line: str) -> str:
    return ascii_lower_text(line.strip(WS))


_hash = xxhash.xxh3_128_digest
_WS = WS.encode()


def _keys(text: str | None) -> list[bytes]:
    """Keys of all lines, as UTF-8; lowering bytes touches A-Z alone."""
    return [line.strip(_WS) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _add(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = old.copy()
    out["docs"] += new["docs"]
    return out


def _count_lines(min_chars: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(counts: Counter) -> pa.RecordBatch:
        found = sorted((_hash(k), n) for k, n in counts.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["hash", "docs"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0
        for batch in batches:
            for text in batch.column(0):
                fresh = {k for k in _keys(text.as_py()) if _counts(k, min_chars)}
                size += sum(len(k) for k in fresh if k not in counts)
                counts.update(fresh)
                if size > held:
                    yield out(counts)
                    counts, size = Counter(), 0
        if counts:
            yield out(counts)

    return run


def _frequent(min_docs: int, memtable: int, fanout: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RunIndex(WIDTH, PAYLOAD, _add, memtable, fanout)
        for batch in batches:
            payload = np.zeros(batch.num_rows, PAYLOAD)
            payload["docs"] = batch.column(1).to_numpy()
            index.add(np.array(batch.column(0).to_pylist(), index.kind), payload)
        keys, payload = index.compacted()
        many = payload["docs"] >= min_docs
        keys, docs = keys[many], payload["docs"][many]
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(keys), [None, pa.py_buffer(keys.tobytes())])
        yield pa.RecordBatch.from_arrays([fixed.cast(pa.binary()), pa.array(docs)], ["hash", "docs"])

    return run


def frequent_lines(
    docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, memtable: int = 200_000, fanout: int = 4, held: int = 8_000_000
) -> DataFrame:
    """(hash, docs) of the line keys of ``min_chars`` code points or more that ``min_docs`` documents hold."""
    counted = materialise(docs.select(text_col).mapInArrow(_count_lines(min_chars, held), "hash binary, docs long"), "line-dedup-counted")
    return counted.repartition(buckets(counted), "hash").mapInArrow(_frequent(min_docs, memtable, fanout), "hash binary, docs long")


def drop_keys(text: str | None, frequent: Callable[[bytes], bool]) -> tuple[str, int, int]:
    """The text without its frequent lines, its lines before, and how many went."""
    lines = (text or "").split("\n")
    kept = [line for line, key in zip(lines, _keys(text), strict=True) if not frequent(key)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _drop(places: list[int], min_chars: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """places: of the text and, where ``shared`` is null, of the document's own frequent hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(shared.value[k : k + WIDTH] for k in range(0, len(shared.value), WIDTH)) if shared else frozenset()
        for batch in batches:
            texts = batch.column(places[0])
            own = batch.column(places[1]) if not shared else None
            kept, n, gone = [], [], []
            for k in range(batch.num_rows):
                mine = known if shared else frozenset(own[k].as_py() or ())
                test = lambda key, mine=mine: _counts(key, min_chars) and bool(mine) and _hash(key) in mine
                text, before, dropped = drop_keys(texts[k].as_py(), test)
                kept.append(text)
                n.append(before)
                gone.append(dropped)
            width = places[2]
            arrays = [batch.column(k) for k in range(width)] + [
                pa.array(kept, pa.string()),
                pa.array(n, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in kept], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])

    return run


def _hashes_of(min_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (d, h)
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for h in {_hash(k) for k in _keys(t.as_py()) if _counts(k, min_chars)}
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.binary())], ["__doc", "hash"]
            )

    return run


def line_dedup(
    docs: DataFrame,
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    broadcast_hashes: int = 1_000_000,
    memtable: int = 200_000,
    fanout: int = 4,
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines``, ``n_dropped`` and ``kept_sha256`` added.

    A text is split at ``\\n``; null and empty texts are one empty line, and null becomes
    the empty text. Keys below ``min_chars`` code points never go, so blank lines stay. A
    document counts once for a key however often it repeats it; repeated rows each count. Columns
    of ``docs`` are carried along; those named as the new ones are replaced.
    """
    added = ["kept_text", "n_lines", "n_dropped", "kept_sha256"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    spark, names = docs.sparkSession, docs.columns
    frequent = materialise(frequent_lines(docs, text_col, min_docs, min_chars, memtable, fanout), "line-dedup-frequent")
    schema = T.StructType(list(docs.schema.fields)).add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")
    at, width = names.index(text_col), len(names)

    def renamed(df: DataFrame, places: list[int], shared) -> DataFrame:
        plain = schema.fieldNames()
        inner = T.StructType([T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(schema.fields)])
        return df.mapInArrow(tidied(_drop(places, min_chars, shared)), inner).toDF(*plain)

    if frequent.count() <= broadcast_hashes:
        shared = spark.sparkContext.broadcast(b"".join(sorted(bytes(r.hash) for r in frequent.select("hash").collect())))
        return renamed(docs, [at, width, width], shared)
    # what goes depends on the text alone, so the text's own digest ties a document to its hashes
    keyed = docs.withColumn("__doc", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    held = (
        keyed.select("__doc", text_col)
        .mapInArrow(_hashes_of(min_chars), "__doc binary, hash binary")
        .join(frequent.select("hash"), "hash")
        .groupBy("__doc")
        .agg(F.collect_set("hash").alias("__hashes"))
    )
    joined = keyed.join(held, "__doc", "left").select(*names, "__hashes")
    return renamed(joined, [at, width, width], None)
