"""Signatures and near pairs are made of many texts at once, and are those of one at a time."""

import hashlib
import heapq

import numpy as np
import pyarrow as pa

from loamwork.functions import digests
from loamwork.operators import dedup


def test_heads_are_those_of_hashlib(monkeypatch):
    monkeypatch.setattr(digests, "STEP", 7)
    rng = np.random.default_rng(4)
    sizes = np.r_[np.arange(140), 55, 56, 0, 64]
    runs = [rng.integers(0, 256, n, np.uint8).tobytes() for n in sizes]
    found = digests.md5_heads(b"".join(runs), np.cumsum(sizes) - sizes, sizes)
    assert found.tolist() == [int.from_bytes(hashlib.md5(r).digest()[:8], "big") for r in runs]
    assert digests.md5_heads(b"", np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_texts_are_signed_together(monkeypatch):
    calls = []
    monkeypatch.setattr(dedup, "md5_heads", lambda *a: (calls.append(len(a[1])), digests.md5_heads(*a))[1])
    texts = [None, "", " \t\x0b", "One", "a b c d e", "a b c d e f", "É x " * 40 + "y" * 80, "a b c d e f " * 50, "w " * 3, None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])

    def alone(text):
        w = [x for x in dedup._WORDS.findall((text or "").lower())]
        found = {hashlib.md5(" ".join(w[a : a + 5]).encode()).digest()[:8] for a in range(max(1, len(w) - 4))} if w else set()
        return b"".join(heapq.nsmallest(9, found))

    (found,) = dedup._packed(5, 9)(iter([batch]))
    assert found.column("sig").to_pylist() == [alone(t) for t in texts] and len(calls) == 1
    empty = pa.record_batch([pa.array([1]), pa.array([None], pa.string())], ["id", "text"])
    assert next(dedup._packed(5, 9)(iter([empty]))).column("sig").to_pylist() == [b""]


def test_counts_of_shared_hashes_are_those_of_sets():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(10**6, 400, replace=False)).astype(np.uint64)

    def block(n):
        sigs = [np.sort(rng.choice(base[: rng.choice([20, 150, 400])], rng.integers(1, 20), replace=False)) for _ in range(n)]
        rows = pa.array([[{"rep": k, "sig": s.astype(">u8").tobytes()} for k, s in enumerate(sigs)]], pa.list_(pa.struct([("rep", pa.int64()), ("sig", pa.binary())])))
        return dedup._Block(rows[0])

    for left, right in ((block(40), block(25)), (same := block(30), same)):
        want = [[p, q] for p, a in enumerate(left.sigs) for q, b in enumerate(right.sigs) if len(np.intersect1d(a, b)) >= 0.3 * min(dedup.K, len(a), len(b)) - 1e-9]
        got = dedup._may_be_alike(left, right, 0.3, step=16).tolist()
        assert [x for x in got if left is not right or x[0] != x[1]] == [x for x in want if left is not right or x[0] != x[1]] and len(got) > 20
