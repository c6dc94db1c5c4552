"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

A pre-token that is an entry of the vocabulary is mostly one token, but not always: merges happen in order of rank,
and may end elsewhere. So each entry is merged once, on the driver and before any text is read, and those that
come out as themselves are proven: a text's pre-tokens among them count one without further work. Only the rest is merged,
the distinct ones of many texts together as rows of a matrix, and a bounded number of those is remembered.

Pre-tokens too long for the matrix are merged by a heap of (rank, place), so a run of a million letters costs n log n.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import tidied

#: Fixed value: how the byte-level splitter cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pre-tokens that a task remembers, and up to how many bytes a pre-token is merged in a matrix and remembered.
REMEMBERED, SHORT = 400_000, 64
#: Characters that are split at once, and whose pre-tokens are held.
PIECE = 1 << 20
_NONE = np.iinfo(np.int32).max
_JOINT = regex.compile(r"\S \S")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such a vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Merges:
    """first: id of each byte; pairs: two ids for each rank; joined: the id that a rank makes of them."""

    first: np.ndarray
    pairs: np.ndarray
    joined: np.ndarray

    @cached_property
    def ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {(a, b): (k, j) for k, ((a, b), j) in reversed([*enumerate(zip(self.pairs.tolist(), self.joined.tolist(), strict=True))])}

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys and ranks by open addressing, a quarter full at most."""
        bits = max(8, int(len(self.pairs)).bit_length() + 2)
        keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        for k, key in reversed([*enumerate(self._keys(self.pairs[:, 0], self.pairs[:, 1]).tolist())]):
            at = self._slot(key, bits)
            while keys[at] not in (-1, key):
                at = (at + 1) & ((1 << bits) - 1)
            keys[at], ranks[at] = key, k
        return keys, ranks, bits

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b

    @staticmethod
    def _slot(keys: np.ndarray | int, bits: int) -> np.ndarray | int:
        return ((keys ^ (keys >> 32) * 0x9E3779B1) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``_NONE`` for those that never merge."""
        keys, ranks, bits = self.table
        own = self._keys(a, b)
        at = self._slot(own, bits)
        out, left = np.full(len(own), _NONE, np.int32), np.arange(len(own))
        while len(left):
            there = keys[at]
            hit = there == own[left]
            out[left[hit]] = ranks[at[hit]]
            on = ~hit & (there != -1)
            left, at = left[on], (at[on] + 1) & ((1 << bits) - 1)
        return out

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, none empty: the pair of lowest rank merges, the leftmost of equals, until none is left."""
        size = np.array([len(w) for w in words], np.int64)
        out = size.copy()
        low = 0
        for width in (8, 16, 32, SHORT):
            rows = np.flatnonzero((size > low) & (size <= width))
            for k in range(0, len(rows), 50_000):
                part = rows[k : k + 50_000]
                out[part] = self._matrix([words[i] for i in part], size[part], width)
            low = width
        for i in np.flatnonzero(size > SHORT):
            out[i] = len(self._by_heap(self.first[np.frombuffer(words[i], np.uint8)].tolist()))
        return out

    def _matrix(self, words: list[bytes], size: np.ndarray, width: int) -> np.ndarray:
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        # a column more on either side, where nothing merges
        ids = np.full((len(words), width + 2), -1, np.int64)
        ids[:, 1:-1] = self.first[raw]
        ids[:, 1:-1][np.arange(width) >= size[:, None]] = -1
        ranks = np.full(ids.shape, _NONE, np.int32)
        i, j = np.nonzero(ids[:, 1:-1] >= 0)
        ranks[i, j + 1] = self.rank(ids[i, j + 1], ids[i, j + 2])
        after = np.tile(np.arange(1, width + 3, dtype=np.int32), (len(words), 1))
        before = np.tile(np.arange(-1, width + 1, dtype=np.int32), (len(words), 1))
        count, row = size.copy(), np.arange(len(words))
        while len(row):
            at = ranks[row].argmin(axis=1)
            rank = ranks[row, at]
            on = rank < _NONE
            row, at, rank = row[on], at[on], rank[on]
            gone = after[row, at]
            to = after[row, gone]
            ids[row, at], ids[row, gone] = self.joined[rank], -1
            ranks[row, gone] = _NONE
            after[row, at], before[row, to] = to, at
            count[row] -= 1
            ahead = before[row, at]
            ranks[row, at] = self.rank(ids[row, at], ids[row, to])
            ranks[row, ahead] = self.rank(ids[row, ahead], ids[row, at])
        return count

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heap = [(rank, k, joined, p) for rank, joined, k, p in heap]
        heapq.heapify(heap)
        while heap:
            _, at, joined, pair = heapq.heappop(heap)
            to = after[at]
            if to >= n or ids[at] != pair[0] or ids[to] != pair[1]:
                continue
            ids[at], ids[to] = joined, -1
            after[at] = after[to]
            if after[to] < n:
                before[after[to]] = at
            for left in (before[at], at):
                right = after[left] if left >= 0 else n
                if right < n and (found := ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, found[1], (ids[left], ids[right])))
        return [i for i in ids if i >= 0]


@dataclass
class Vocabulary:
    """whole: vocabulary strings that are proven to encode alone as one token; special: strings that are one token wherever they stand."""

    merges: Merges
    whole: list[str]
    special: list[str]


def read_vocabulary(path: str) -> Vocabulary:
    """Of a byte-level BPE file for ``tokenizers``; another kind is refused, as its counts would be wrong."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, split = found["model"], found["pre_tokenizer"] or {}
    plain = [found.get("normalizer"), found.get("truncation"), found.get("padding"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"), model.get("byte_fallback"), split.get("add_prefix_space")]
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or any(plain):
        raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix, suffix or truncation is counted here")
    added = found.get("added_tokens") or []
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError(f"{path}: added tokens that take in their surroundings aren't counted here")
    letters, ids = byte_letters(), model["vocab"]
    first = np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = Merges(first, np.array([(ids[a], ids[b]) for a, b in pairs], np.int64).reshape(-1, 2), np.array([ids[a + b] for a, b in pairs], np.int64))
    raw = [bytes(letters[c] for c in name) for name in ids if name and all(c in letters for c in name)]
    texts = [r.decode("utf-8", "ignore") for r in raw]
    # merged to one, it is the token of its own bytes
    whole = [t for t, r, n in zip(texts, raw, merges.lengths(raw), strict=True) if n == 1 and t.encode() == r]
    return Vocabulary(merges, whole, sorted((a["content"] for a in added if a["content"]), key=len, reverse=True))


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut where a single space stands between others: a pre-token begins there, whatever is before."""
    at = 0
    while len(text) - at > size and (joint := _JOINT.search(text, at + size)):
        yield text[at : joint.start() + 1]
        at = joint.start() + 1
    yield text[at:]


class Counter:
    """Counts the tokens of many texts. costs: tokens of a pre-token, one for each proven string and else what merging gave."""

    def __init__(self, vocabulary: Vocabulary, path: str):
        self.vocabulary, self.path = vocabulary, path
        self.costs = dict.fromkeys(vocabulary.whole, 1)
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self.splitter, self.sure = None, set(map(chr, range(128)))
        self.held: list[tuple[int, list[str]]] = []
        self.size, self.found = 0, np.zeros(0, np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        self.found = np.zeros(len(texts), np.int64)
        for at, text in enumerate(texts):
            if not text:
                continue
            parts = [text] if self.special is None else self.special.split(text)
            self.found[at] += len(parts) - 1
            for part in parts:
                split = self._own if self._is_sure(part) else self._library
                for piece in pieces(part):
                    self.held.append((at, split(piece)))
                    self.size += len(piece)
                    if self.size >= PIECE:
                        self._settle()
        self._settle()
        return self.found

    def _settle(self) -> None:
        """Merges what is new among the pre-tokens held, and counts these."""
        new = [*set().union(*(words for _, words in self.held)).difference(self.costs)]
        lengths = dict(zip(new, self.vocabulary.merges.lengths([w.encode() for w in new]).tolist(), strict=True))
        if len(self.costs) + len(lengths) > REMEMBERED + len(self.vocabulary.whole):
            known = self.costs
            self.costs = dict.fromkeys(self.vocabulary.whole, 1)
            lengths |= {w: known[w] for _, words in self.held for w in words if w in known}
        self.costs |= lengths
        for at, words in self.held:
            self.found[at] += sum(map(self.costs.__getitem__, words))
        for w in new:  # one that is very long isn't kept
            if len(w) > SHORT:
                del self.costs[w]
        self.held, self.size = [], 0

    def _is_sure(self, text: str) -> bool:
        """Whether all characters have a category here: else a library of another Unicode version may take them for letters or numbers."""
        if text.isascii():
            return True
        new = set(text) - self.sure
        self.sure |= {c for c in new if unicodedata.category(c) != "Cn"}
        return new <= self.sure

    def _own(self, piece: str) -> list[str]:
        return self.words.findall(piece)

    def _library(self, piece: str) -> list[str]:
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [piece[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(piece)]


def _counts(vocabulary, path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.value, path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n = pa.array(counter.counts(batch.column(1).to_pylist()))
                size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, n], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row: its text's UTF-8 bytes and tokens, and whether these are more than ``limit``.

    path: a byte-level BPE file for the ``tokenizers`` library, on every machine; counts are those of its ``encode`` without added tokens.
    Strings of special tokens inside a text are one token, as is that library's default. Null texts count as empty: no bytes, no tokens.
    Ids may be null or repeat, of any type; every row gives a row. An empty table gives none. Other columns are not read, so their names can't clash.
    No shuffle; memory is bounded by a batch of texts, a piece of a text and ``REMEMBERED`` pre-tokens, but for a text without single spaces, which is one piece.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    counted = narrow.mapInArrow(tidied(_counts(vocabulary, path)), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
