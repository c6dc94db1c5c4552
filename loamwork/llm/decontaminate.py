"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles. Each partition has its own
signature size and its own threshold: of an item of q shingles, a document that contains it to the
threshold t lacks at most floor((1 - t) q), so of the item's k smallest shingle hashes (its bottom-k MinHash) at least
k - floor((1 - t) q) are in the document. A partition's k is the most that its items may lack and ``_ASKED`` more, so
that larger items, of which there is more to go by, are only brought up by several of their hashes. Documents of any length are searched
by one pass over their own shingle hashes; for each item that its partition's threshold brings up,
exact containment is counted over the shingles themselves.
So nothing at or above the threshold is missed, and nothing below it returned.

Items go to the map tasks in blocks of bounded size, one after the other; a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import byte_words, materialise

SHINGLE, THRESHOLD = 5, 0.8
#: Of a size class 2^c to 2^(c + 1) - 1, the hashes that a document must have at least: for c up to 2, up to 4, and beyond.
_ASKED = (1, 2, 4)


def shingles(found: list[bytes], size: int) -> list[bytes]:
    return [b" ".join(found[k : k + size]) for k in range(len(found) - size + 1)]


def may_lack(q: int, threshold: float) -> int:
    """Shingles of q that may be absent with containment still at the threshold."""
    m = int(q * (1 - threshold)) + 1
    while m > 0 and (q - m) / q < threshold:
        m -= 1
    return m


class Partition:
    """Items of 2^c to 2^(c + 1) - 1 shingles of one length, by the hashes of their signatures."""

    def __init__(self, c: int, threshold: float):
        self.threshold = threshold
        self.size = may_lack(2 ** (c + 1) - 1, threshold) + _ASKED[0 if c < 3 else 1 if c < 5 else 2]
        self.items: dict[int, list[int]] = defaultdict(list)
        self.least: dict[int, int] = {}

    def add(self, item: int, own: frozenset[bytes]) -> None:
        signature = sorted({xxhash.xxh3_64_intdigest(s) for s in own})[: self.size]
        # two shingles of one hash only lower what is asked for
        self.least[item] = max(1, len(signature) - may_lack(len(own), self.threshold))
        for h in signature:
            self.items[h].append(item)

    def met(self, hashes: Iterable[int]) -> list[int]:
        """Items of which enough hashes are there."""
        found = Counter(chain.from_iterable(self.items[h] for h in hashes if h in self.items))
        return [i for i, n in found.items() if n >= self.least[i]]


class ItemIndex:
    """A block of items, partitioned by shingle length (items of fewer words than ``size`` are one shingle) and number of shingles."""

    def __init__(self, items: list[tuple[int, str]], size: int, threshold: float):
        self.threshold = threshold
        self.sets: list[frozenset[bytes]] = []
        self.ids: list[int] = []
        self.parts: dict[int, dict[int, Partition]] = defaultdict(dict)
        for item, text in items:
            found = byte_words(text)
            if not found:
                continue
            length = min(size, len(found))
            own = frozenset(shingles(found, length))
            c = len(own).bit_length() - 1
            self.parts[length].setdefault(c, Partition(c, threshold)).add(len(self.ids), own)
            self.sets.append(own)
            self.ids.append(item)
        self.hashes = {n: np.array(sorted({h for part in of.values() for h in part.items}), np.uint64) for n, of in self.parts.items()}

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, its shingles, those that the text has) for each item that the text contains to the threshold."""
        found = byte_words(text)
        out = []
        for n, wanted in self.hashes.items():
            if len(found) < n:
                continue
            own = shingles(found, n)
            h = xxhash.xxh3_64_intdigest
            met = np.array([h(s) for s in own], np.uint64)
            at = np.searchsorted(wanted, met)
            at[at == len(wanted)] = 0
            hits = set(met[wanted[at] == met].tolist())
            near = [i for part in self.parts[n].values() for i in part.met(hits)] if hits else []
            have = set(own) if near else ()
            for i in near:
                q, m = len(self.sets[i]), len(self.sets[i] & have)
                if m / q >= self.threshold:
                    out.append((self.ids[i], q, m))
        return sorted(out)


def _blocks(items: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    held: list[tuple[int, str]] = []
    size = 0
    for row in items.select(id_col, F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1]) + 64
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(docs: DataFrame, id_col: str, text_col: str, items: list[tuple[int, str]], size: int, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, size, threshold)
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in index.search(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["d", "i", "q", "m"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "d long, i long, q long, m long")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of each item that a document contains.

    Containment is the share of the item's distinct shingles (``size`` lower-cased words; all
    words of a shorter item) that the whole document has, and ``threshold`` or more of it counts. Null
    and empty texts contain nothing and are contained in nothing. A document row gives its own
    rows however often it is repeated; repeated items too. Empty tables give no rows. Ids are integers, or numbers as text.
    """
    blocks = _blocks(items, item_id, item_text, block_chars)
    out = _search(docs, id_col, text_col, next(blocks, []), size, threshold)
    for block in blocks:
        out = materialise(out, "contained").union(_search(docs, id_col, text_col, block, size, threshold))
    return out.select(
        F.col("d").alias(id_col), F.col("i").alias(item_id), F.col("q").alias("n_shingles"), F.col("m").alias("n_found"), (F.col("m") / F.col("q")).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, block_chars: int = 8_000_000) -> DataFrame:
    """``docs`` without the rows whose text contains an item; columns and repeated rows stay as they are."""
    out = docs
    schema, at = docs.schema, docs.columns.index(text_col)
    for k, block in enumerate(_blocks(items, item_id, item_text, block_chars)):
        out = materialise(out, "decontaminated") if k else out
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, size, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not index.search(t.as_py()) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
