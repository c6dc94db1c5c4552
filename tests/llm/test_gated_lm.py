import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamwork.llm import gated_lm as lm
from loamwork.llm.common import byte_words

rng = np.random.default_rng(0)


def rows():
    vocab = ["w%s" % (i if i < 2500 else "é%d" % i) for i in range(4000)]
    p = 1 / np.arange(1, 4001)
    out = [(i, " ".join(np.random.default_rng(i).choice(vocab, 60 + i % 50, p=p / p.sum()))) for i in range(120)]
    return out + [(200, None), (201, ""), (None, "A w1 \x0b unseen"), (203, "W1\tw2"), (203, "W1\tw2"), (204, "w1 " * 5000), (205, "z" * 60_000)]


def plain_base(data):
    low = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in data:
        if not held(i):
            counts.update([*low(t), None])
    total = sum(counts.values())
    out = []
    for i, t in data:
        w = [*low(t), None]
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (len(counts) + 1))) for x in w)
        out.append((str(i), held(i), len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    return sorted(out)


def test_counts_and_base_scores(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in data], "doc_id long, text string, n_tokens int, word string").repartition(3)
    want = plain_base(data)
    scores = []
    for shape in ({}, {"head_words": 30, "bytes_at_once": 2000}):
        got = lm.lm_scores(docs, start_tokens=3000, **shape).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        scores.append(sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out))
    assert scores[0]
    assert lm.lm_scores(docs.where("false")).collect() == []
    lone = lm.lm_scores(docs.where("doc_id is null")).collect()
    assert lone[0].train_tokens == 0 and lone[0].n_known == 0 and math.isfinite(lone[0].score)


def test_gradients_by_differences():
    p = {k: v.astype(np.float64) for k, v in lm.new_params().items()}
    ids = rng.integers(0, lm.TOP + lm.ENDINGS, (6, 5))
    goal, real = rng.integers(0, lm.TOP + lm.ENDINGS, (6, 5)), rng.random((6, 5)) < 0.8
    h = rng.normal(size=(5, lm.HIDDEN))
    g, _, _ = lm.gradients(p, ids, goal, real, h)
    places = {"x": (0, ids[2, 1], 7), "u": (1, 3, 8), "wc": (5, int(goal[0, 0]) // lm.IN_CLASS), "bc": (20,), "ww": None, "bw": None}
    top = next((t, k) for t in range(6) for k in range(5) if real[t, k])
    c, w = goal[top] // lm.IN_CLASS, goal[top] % lm.IN_CLASS
    places |= {"ww": (c, 4, w), "bw": (c, w)}
    for k, at in places.items():
        losses = []
        for d in (1e-5, -1e-5):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += d
            losses.append(lm.gradients(q, ids, goal, real, h)[2])
        assert np.isclose((losses[0] - losses[1]) / 2e-5, g[k][at], rtol=2e-2, atol=1e-6), k


def test_probabilities_sum_to_one():
    p = lm.new_params()
    words, counts = [lm.END.encode(), *[b"t%d" % k for k in range(lm.TOP + 200)]], np.arange(lm.TOP + 201, 0, -1)
    rest = np.zeros(lm.ENDINGS)
    for w, n in zip(words[lm.TOP :], counts[lm.TOP :], strict=True):
        rest[lm.ending(w)] += n + lm.SMOOTH
    head = lm.Head(words, counts, int(counts.sum()), len(words), rest)
    h = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.TOP + lm.ENDINGS)
    logs = lm.log_probs(p, np.repeat(h, len(every), 0), every)
    within = [(10 ** head.log_counts[k] / 10 ** head.log_rest[head.ids[k] - lm.TOP], head.ids[k]) for k in range(lm.TOP, len(words))]
    total = np.exp(logs[: lm.TOP]).sum() + sum(np.exp(logs[i]) * share for share, i in within)
    unseen = (np.exp(logs[lm.TOP :]) * lm.SMOOTH / 10**head.log_rest).sum()
    assert np.isclose(total + unseen, 1, atol=1e-3)


def plain_step(p, h, before):
    z, r, n = p["x"][:, before]
    uz, ur, un = (h @ u for u in p["u"])
    z, r = 1 / (1 + np.exp(-z - uz)), 1 / (1 + np.exp(-r - ur))
    n = np.tanh(n + r * un)
    return n + z * (h - n)


def test_state_is_carried_over_whole_texts():
    p = lm.new_params(5)
    texts = [rng.integers(0, lm.TOP, n).astype(np.int32) for n in (1, 700, 3, 50, 129, 128, 2)]
    want = []
    for ids in texts:
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for before, now in zip(np.r_[9, ids[:-1]], ids, strict=True):
            h = plain_step(p, h, before)
            total += float(lm.log_probs(p, h, np.array([now]))[0])
        want.append(total)
    for lanes in (1, 3, 64):
        assert np.allclose(lm.score_many(p, texts, 9, lanes), want, rtol=1e-4)


def test_training_takes_every_token_in_the_order_of_its_text(monkeypatch):
    """All tokens of all texts are learned, each behind the one before it, with a fresh state just in front of a text."""
    texts = [rng.integers(0, lm.TOP, n).astype(np.int32) for n in (1, 64, 65, 5000, 3, 300, 2, 31)]
    seen = []

    def spy(p, ids, targets, real, h, fresh=None, room=None):
        for lane in range(ids.shape[1]):
            for t in np.flatnonzero(real[:, lane]).tolist():
                seen.append((int(targets[t, lane]), int(ids[t, lane]), bool(fresh[t, lane])))
        return {k: np.zeros_like(v) for k, v in p.items()}, h.copy(), 0.0

    monkeypatch.setattr(lm, "gradients", spy)
    trainer = lm.Trainer(lm.new_params(), 0.1, 7, 4)
    for x in texts:
        trainer.add(x)
    trainer.finish()
    want = [(int(now), int(before), k == 0) for x in texts for k, (before, now) in enumerate(zip(np.r_[7, x[:-1]], x, strict=True))]
    assert sorted(seen) == sorted(want) and trainer.tokens == len(want)


def test_training_carries_the_state_from_window_to_window():
    """Lanes and windows change nothing of a text's states: the last ones are those of going through it step by step."""
    p = lm.new_params(4)
    ids = rng.integers(0, lm.TOP, 150).astype(np.int32)
    lanes, h, fresh = lm.Lanes(2, 9), np.zeros((1, lm.HIDDEN), np.float32), None
    lanes.add(ids)
    goal, given, fresh, held, _ = lanes.block(160)
    assert held.tolist() == [150]
    for at in range(0, 150, 50):
        cut = slice(at, at + 50)
        _, h, _ = lm.gradients(p, given[cut], goal[cut], np.ones((50, 1), bool), h, fresh[cut])
    want = np.zeros((1, lm.HIDDEN), np.float32)
    for before in np.r_[9, ids[:-1]]:
        want = plain_step(p, want, before)
    assert np.allclose(h, want, atol=1e-5)


def test_a_fresh_text_cuts_the_slopes():
    p = {k: v.astype(np.float64) for k, v in lm.new_params().items()}
    ids, goal = rng.integers(0, lm.TOP, (6, 2)), rng.integers(0, lm.TOP, (6, 2))
    fresh = np.zeros((6, 2), bool)
    fresh[0], fresh[4, 1] = True, True
    zero = np.zeros((2, lm.HIDDEN))
    whole = lm.gradients(p, ids, goal, np.ones((6, 2), bool), zero + 0.5, fresh)[0]
    parts = [(ids[:, :1], goal[:, :1]), (ids[:4, 1:], goal[:4, 1:]), (ids[4:, 1:], goal[4:, 1:])]
    for k in whole:
        total = sum(lm.gradients(p, a, b, np.ones(a.shape, bool), zero[:1])[0][k] * a.size for a, b in parts) / 12
        assert np.allclose(whole[k], total, atol=1e-12), k


def test_word_hashes_are_those_of_spark(spark):
    words = ["a", "é", "w" * 100, " ", "wort", ""]
    a, b = lm._word_hash(F.col("w"))
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", a.alias("a"), b.alias("b")).collect():
        assert tuple(x % (1 << 64) for x in (r.a, r.b)) == lm.word_hash(r.w.encode())


def test_words_and_endings_of_arrow_arrays():
    texts = ["  A\x0bb\x0c c\r\n\td  ", "", None, "\x1c x\x85y\xa0z\u2028w É", "A\x00B c", "   ", "z" * 300, "ÉÀ"]
    for arrow in (pa.array(texts), pa.array(["x y", *texts, "q"]).slice(1, len(texts))):
        found, ends = lm.split_words(arrow)
        assert [[w.encode() for w in found.to_pylist()[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [byte_words(t) for t in texts]
        assert lm.endings(found).tolist() == [lm.ending(w.encode()) for w in found.to_pylist()]
        for cut in (1, 3, 99):
            batches = [pa.RecordBatch.from_arrays([arrow.slice(k, cut)], ["t"]) for k in range(0, len(arrow), cut)]
            for most in (1, 10, 320, 10**6):
                parts = [p.column(0).to_pylist() for p in lm.portions(iter(batches), 0, most)]
                assert [t for p in parts for t in p] == texts and all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= most for p in parts)
        assert len(parts) == 1


def test_frequent_words_are_whole_levels_of_counts(spark):
    counts = {f"w{k}": 1 + 10_000 // (k + 1) for k in range(500)} | {"x" * 41: 10**9}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    words, own = lm.frequent_words(frame, lm.tallied(frame), 100)
    fit = {w: n for w, n in counts.items() if len(w) <= lm.HEAD_BYTES}
    order = sorted(fit, key=lambda w: (-fit[w], w))
    assert words == [w.encode() for w in order[: len(words)]] and own.tolist() == [fit[w] for w in order[: len(words)]]
    assert 80 <= len(words) <= 100
    same = spark.createDataFrame([(f"w{k}", 1) for k in range(300)], "word string, n long")
    assert len(lm.frequent_words(same, lm.tallied(same), 100)[0]) == 100 and len(lm.frequent_words(same, lm.tallied(same), 300)[0]) == 300


def test_a_very_long_text_takes_no_rectangle():
    import tracemalloc

    p = lm.new_params()
    texts = [rng.integers(0, lm.TOP, n).astype(np.int32) for n in [300_000, *[100] * 300]]
    tracemalloc.start()
    got = lm.score_many(p, texts, 0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6 and np.isfinite(got).all()


def test_the_sample_is_bounded_by_tokens_and_long_words_are_told(spark, monkeypatch):
    long = "w" * 50
    rows = [(k, f"{long} {'v' * 60}{k % 3} word {k % 5}") for k in range(40)] + [(100, "one two three " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    sizes, real = [], lm.Trainer.add
    monkeypatch.setattr(lm.Trainer, "add", lambda self, ids: sizes.append(len(ids)) or real(self, ids))
    monkeypatch.setattr(lm, "START_CHARS", 500)
    whole = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in lm.lm_scores(docs, start_tokens=10**6).collect())
    assert max(sizes) <= 260  # the driver's own
    monkeypatch.setattr(lm, "OFTEN", 1)
    assert sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in lm.lm_scores(docs, start_tokens=10**6).collect()) == whole
    monkeypatch.setattr(lm, "HEAD_BYTES", 200)
    assert sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in lm.lm_scores(docs, start_tokens=10**6).collect()) == whole
