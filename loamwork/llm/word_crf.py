"""Language of words and texts by a linear-chain conditional random field.

A word's features are its affixes, character n-grams and, for words that the training
sample repeats, itself (the lexicon); transitions between the labels of
neighbouring words are learned too. Training sequences splice pieces of texts in
different languages, so the transitions learn how likely a switch is. Labels come from
forward-backward marginals; a text's language is the label with the largest mean marginal.

Forward-backward over a long text runs in blocks: the transfer matrices of all
blocks are multiplied up side by side, blocks are chained, and each block is then
filled in from its ends. It is exact for any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.llm.common import bounded_batches, tidied

UNKNOWN = "und"
BUCKETS = 1 << 17
BLOCK = 32
#: Words a worker remembers the scores of, and how long such a word may be.
CACHE, CACHE_CHARS = 200_000, 40
#: Words that forward-backward takes at once.
AT_ONCE = 60_000
_WORD = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower()) if text else []
    return found if not found or found[0].isascii() or any(c.isalpha() for w in found for c in w) else []


def word_features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Hashed feature numbers; 0 is the bias."""
    w = f"^{word}$"
    n = len(w)
    names = [w[:k] for k in range(2, min(5, n + 1))] + ["<" + w[-k:] for k in range(2, min(5, n + 1))]
    names += ["2" + w[k : k + 2] for k in range(n - 1)] + ["3" + w[k : k + 3] for k in range(n - 2)]
    if word in lexicon:
        names.append("=" + word)
    return [0] + [1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in names]


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    lexicon: frozenset[str]


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of equally long sequences, pair expectations summed over all, and log partition sums.

    scores: (sequences, words, labels); moves: (labels, labels), both logarithms.
    """
    n, t, k = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, m = np.exp(scores - top), np.exp(moves)
    alpha, beta, scale = np.empty((n, t, k)), np.empty((n, t, k)), np.empty((n, t))
    a = e[:, 0]
    for i in range(t):
        if i:
            a = (alpha[:, i - 1] @ m) * e[:, i]
        scale[:, i] = a.sum(axis=1)
        alpha[:, i] = a / scale[:, i, None]
    beta[:, -1] = 1
    for i in range(t - 2, -1, -1):
        beta[:, i] = ((beta[:, i + 1] * e[:, i + 1]) @ m.T) / scale[:, i + 1, None]
    pairs = np.einsum("ntk,ntl->kl", alpha[:, :-1], beta[:, 1:] * e[:, 1:] / scale[:, 1:, None]) * m
    return alpha * beta, pairs, np.log(scale).sum(axis=1) + top[:, :, 0].sum(axis=1)


def train(samples: list[tuple[str, str]], words_a_label: int = 60_000, length: int = 48, epochs: int = 4, seed: int = 7) -> Model | None:
    """Fits a model to (text, label) samples; None without any label with words."""
    rng = np.random.default_rng(seed)
    by: dict[str, list[list[str]]] = {}
    for text, label in samples:
        if found := letter_words(text):
            by.setdefault(label, []).append(found)
    labels = sorted(by)
    if not labels:
        return None
    counts = Counter(w for of in by.values() for found in of for w in found)
    lexicon = frozenset(w for w, n in counts.items() if n >= 5 and len(w) <= CACHE_CHARS)
    pieces: list[tuple[int, list[str]]] = []
    for k, label in enumerate(labels):
        # texts repeat until every label has as many words
        have, order = 0, rng.permutation(len(by[label]))
        while have < words_a_label:
            for i in order:
                found = by[label][i]
                at = 0
                while at < len(found) and have < words_a_label:
                    step = int(rng.integers(6, 2 * length))
                    pieces.append((k, found[at : at + step]))
                    have += len(pieces[-1][1])
                    at += step
    rng.shuffle(pieces)
    stream = [(k, w) for k, piece in pieces for w in piece]
    usable = len(stream) // length * length
    if not usable:
        length = usable = len(stream)
    vocab: dict[str, int] = {}
    ids = np.array([vocab.setdefault(w, len(vocab)) for _, w in stream[:usable]]).reshape(-1, length)
    gold = np.array([k for k, _ in stream[:usable]]).reshape(-1, length)
    rows = [word_features(w, lexicon) for w in vocab]
    sizes = np.array([len(r) for r in rows])
    flat, starts = np.concatenate([np.array(r) for r in rows]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n_labels = len(labels)
    weights, moves = np.zeros((BUCKETS, n_labels)), np.zeros((n_labels, n_labels))
    seen_w, seen_m = np.full(BUCKETS, 1e-6), np.full((n_labels, n_labels), 1e-6)
    batch = 64
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // batch)):
            x, y = ids[at], gold[at]
            some, back = np.unique(x, return_inverse=True)
            places = np.concatenate([flat[s : s + z] for s, z in zip(starts[some], sizes[some], strict=True)])
            own = np.repeat(np.arange(len(some)), sizes[some])
            scores = np.zeros((len(some), n_labels))
            np.add.at(scores, own, weights[places])
            found, pairs, _ = forward_backward(scores[back].reshape(*x.shape, n_labels), moves)
            found[np.arange(len(x))[:, None], np.arange(length), y] -= 1
            by_word = np.zeros_like(scores)
            np.add.at(by_word, back.ravel(), found.reshape(-1, n_labels))
            touched, where = np.unique(places, return_inverse=True)
            g = np.zeros((len(touched), n_labels))
            np.add.at(g, where, by_word[own])
            g = g / len(x) + 1e-5 * weights[touched]
            seen_w[touched] += (g**2).mean(axis=1)
            weights[touched] -= 0.15 * g / np.sqrt(seen_w[touched])[:, None]
            real = np.zeros_like(moves)
            np.add.at(real, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g = (pairs - real) / len(x) + 1e-4 * moves
            seen_m += g**2
            moves -= 0.15 * g / np.sqrt(seen_m)
    return Model(labels, weights.astype(np.float32), moves, lexicon)


class Tagger:
    """Applies a model; remembers the label scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.labels)))

    def scores(self, found: list[str]) -> np.ndarray:
        """(words, labels) emission scores."""
        get = self.known.get
        at = np.array([get(w, -1) for w in found], np.int64)
        out = np.empty((len(found), len(self.model.labels)))
        have = at >= 0
        out[have] = self.table[at[have]]
        lost = np.flatnonzero(~have).tolist()
        if lost:
            fresh: dict[str, int] = {}
            places = [fresh.setdefault(found[k], len(fresh)) for k in lost]
            rows = [word_features(w, self.model.lexicon) for w in fresh]
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64)
            values = np.add.reduceat(self.model.weights[np.concatenate([np.array(r) for r in rows])].astype(np.float64), starts, axis=0)
            out[lost] = values[places]
            room = [k for k, w in enumerate(fresh) if len(w) <= CACHE_CHARS][: CACHE - len(self.known)]
            if room:
                names = list(fresh)
                for n, k in enumerate(room):
                    self.known[names[k]] = len(self.table) + n
                self.table = np.concatenate([self.table, values[room]])
        return out

    def marginals(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Label marginals of each word; ``sizes`` words belong to each sequence in turn, none of them 0."""
        k = scores.shape[1]
        m = np.exp(self.model.moves)
        e_flat = np.exp(scores - scores.max(axis=1, keepdims=True))
        per = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        n_blocks = int(per.sum())
        seq = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        block, slot = first[seq] + within // BLOCK, within % BLOCK
        e = np.ones((BLOCK, n_blocks, k))
        e[slot, block] = e_flat
        used = np.bincount(block, minlength=n_blocks)
        # blocks by falling length: the rows in use at a slot are the first ones
        order = np.argsort(-used, kind="stable")
        e, used = np.ascontiguousarray(e[:, order]), used[order]
        active = (used[None, :] > np.arange(BLOCK)[:, None]).sum(axis=1)
        starts_seq = np.zeros(n_blocks, bool)
        starts_seq[first] = True
        head = starts_seq[order]
        step = np.where(head[:, None, None], np.eye(k), m)  # no move into a sequence's first word
        through = np.ascontiguousarray(step * e[0][:, None, :])
        for t in range(1, BLOCK):
            c = active[t]
            if not c:
                break
            part = (through[:c] @ m) * e[t, :c, None, :]
            through[:c] = part / part.max(axis=(1, 2), keepdims=True)
        place = np.empty(n_blocks, np.int64)
        place[order] = np.arange(n_blocks)
        into, out_of = np.ones((n_blocks, k)), np.ones((n_blocks, k))
        longest = np.argsort(-per, kind="stable")
        counts = per[longest]
        a = np.ones((len(sizes), k))
        for j in range(int(counts[0]) if len(counts) else 0):
            c = int((counts > j).sum())
            at = place[first[longest[:c]] + j]
            into[at] = a[:c]
            a = np.einsum("nk,nkl->nl", a[:c], through[at])
            a /= a.sum(axis=1, keepdims=True)
        b = np.ones((len(sizes), k))
        for j in range(int(counts[0]) - 1 if len(counts) else -1, -1, -1):
            c = int((counts > j).sum())
            at = place[first[longest[:c]] + j]
            out_of[at] = b[:c]
            b[:c] = np.einsum("nkl,nl->nk", through[at], b[:c])
            b[:c] /= b[:c].sum(axis=1, keepdims=True)
        alpha = np.empty_like(e)
        a = np.einsum("nk,nkl->nl", into, step) * e[0]
        for t in range(BLOCK):
            c = active[t]
            if not c:
                break
            if t:
                a = (alpha[t - 1, :c] @ m) * e[t, :c]
            alpha[t, :c] = a / a.sum(axis=1, keepdims=True)
        beta = np.ones_like(e)
        # each block's last word takes what follows the block
        beta[used - 1, np.arange(n_blocks)] = out_of
        for t in range(BLOCK - 2, -1, -1):
            c = active[t + 1]
            if c:
                b = (beta[t + 1, :c] * e[t + 1, :c]) @ m.T
                beta[t, :c] = b / b.sum(axis=1, keepdims=True)
        both = alpha[slot, place[block]] * beta[slot, place[block]]
        return both / both.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, mean marginal of it) of each text."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            if found := letter_words(text):
                held.append((k, found))
                size += len(found)
            if held and (size > AT_ONCE or k == len(texts) - 1):
                sizes = np.array([len(f) for _, f in held])
                both = self.marginals(self.scores([w for _, f in held for w in f]), sizes)
                means = np.add.reduceat(both, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                for (i, _), row in zip(held, means, strict=True):
                    best = int(row.argmax())
                    out[i] = (self.model.labels[best], float(min(1.0, row[best])))
                held, size = [], 0
        return out

    def label_words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, marginal) of each word of a text that may switch languages."""
        found = letter_words(text)
        if not found:
            return []
        both = self.marginals(self.scores(found), np.array([len(found)]))
        return [(w, self.model.labels[int(r.argmax())], float(r.max())) for w, r in zip(found, both, strict=True)]


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the CRC32 of the id as text has this remainder; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(0)) == remainder


def labelled_sample(docs: DataFrame, text_col: str, label_col: str, per_label: int) -> list[tuple[str, str]]:
    """At most ``per_label`` distinct texts of each label, by a hash of the text: one count per label and one filtered scan."""
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, label_col)
    draw = F.shiftrightunsigned(F.xxhash64(F.col(text_col), F.lit(11)), 11) / float(1 << 53)
    # copies share one draw, so they count once
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).agg(F.count_distinct(draw)).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.3 * per_label / n + 20 / n))])[F.col(label_col)]
    out: dict[str, list[tuple[float, str]]] = {}
    for r in labelled.withColumn("draw", draw).where(F.col("draw") < share).dropDuplicates(["draw"]).toLocalIterator():
        out.setdefault(r[1], []).append((r[2], r[0]))
    return [(text, label) for label, of in sorted(out.items()) for _, text in sorted(of)[:per_label]]


def identify_language(docs: DataFrame, model: Model | None, text_col: str = "text", unmodelled: str = UNKNOWN) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added; only the text is looked at.

    Null texts and texts without a letter are ``und`` with score 0. If there is no model, every other text
    is ``unmodelled`` with score 0. Rows are independent: repeated rows come out alike, empty tables empty. Columns of ``docs`` are carried; those
    named as the new ones are replaced.
    """
    docs = bounded_batches(docs).select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    at, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]).add(f"c{width}", "string").add(f"c{width + 1}", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for batch in batches:
            got: list[tuple[str, float]] = []
            for first in range(0, batch.num_rows, 500):
                texts = batch.column(at).slice(first, 500).to_pylist()
                got += tagger.predict(texts) if tagger else [(unmodelled if letter_words(t) else UNKNOWN, 0.0) for t in texts]
            arrays = [batch.column(k) for k in range(width)] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])

    return docs.mapInArrow(tidied(run), schema).toDF(*docs.columns, "lang_pred", "score")


def fit_and_identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = 300, words_a_label: int = 60_000, unmodelled: str = UNKNOWN
) -> DataFrame:
    """Trains on the labelled rows that are not held out (CRC32 of the id mod 4 is not 2) and identifies every row.

    The training sample is bounded by ``per_label`` texts and ``words_a_label`` words of each label.
    Adds ``held_out``, ``lang_pred`` and ``score``. Without a labelled text to train on, texts with letters are ``unmodelled``.
    """
    docs = docs.select(*[c for c in docs.columns if c != "held_out"]).withColumn("held_out", held_out(id_col, 4, 2))
    model = train(labelled_sample(docs.where(~F.col("held_out")), text_col, label_col, per_label), words_a_label)
    return identify_language(docs, model, text_col, unmodelled)
