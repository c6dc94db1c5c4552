import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm import hard_negatives
from loamwork.llm.hard_negatives import Running, mine_hard_negatives, products
from loamwork.operators import tiles

SHAPE = "vec_id long, label int, embedding array<float>, id string, score int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    kept = []
    for i, label, v, *_ in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in kept:
        if i % 10:
            continue
        scored = [(min(max(sum(x * y for x, y in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), j, other == label) for j, other, w in kept if len(w) == len(v)]
        order = lambda of: sorted(of, key=lambda x: (-x[0], x[1]))
        for ps, p, _ in order([x for x in scored if x[2] and x[1] != i])[:positives]:
            inside = [x for x in scored if not x[2] and low * ps <= 100 * x[0] <= high * ps]
            for rank, (ns, n, _) in enumerate(order(inside)[:negatives]):
                out.append((i, p, rank + 1, n, ps, ns))
    return sorted(out)


def found(spark, rows, **more):
    table = spark.createDataFrame(rows, SHAPE).repartition(3)
    return sorted(tuple(r) for r in mine_hard_negatives(table, F.col("id") % 10 == 0, **more).collect())


def made(n, draw, dim=6, scale=1.0):
    return [(k, draw.randrange(3), [draw.choice((-1, 0, 0.5, 1)) * scale * draw.choice((1, 1, 0.3)) for _ in range(dim)], "x", 1) for k in range(n)]


def test_as_brute_force_with_ties_and_small_tiles(spark, monkeypatch):
    draw = random.Random(3)
    rows = made(300, draw)
    want = brute(rows)
    assert len(want) > 500
    assert found(spark, rows) == want
    assert found(spark, rows, tile=7, block=3) == want
    monkeypatch.setattr(tiles.meet, "__defaults__", (200,))
    assert found(spark, rows, tile=16, block=4) == want  # blocks and groups beyond what is broadcast


def test_odd_rows(spark):
    draw = random.Random(5)
    rows = made(80, draw)
    rows += [(None, 1, [1.0] * 6, None, None), (90, None, [1.0] * 6, None, 1), (100, 1, None, "", 1), (110, 1, [1.0, None] * 3, "", 1), (120, 2, [float("nan")] * 6, "", 1), (130, 0, [float("inf")] * 6, "", 1)]
    rows += [(140, 1, [], "", 1), (141, 1, [], "", 1), (142, 2, [], "", 1), (150, 1, [0.5, 0.5], "", 1), (151, 1, [0.5, 0.25], "", 1), (152, 0, [0.25, 0.25], "", 1)]
    rows += [rows[20], rows[33], rows[33], rows[40]]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(0, 1, [1.0], "", 1)]) == []
    one = [(k, 1, [1.0, 2.0], "", 1) for k in range(40)]
    assert found(spark, one) == []  # one label: positives, no negatives
    same = [(k, k % 2, [1.0, 2.0] if k % 2 == 0 else [0.5, 1.0], "", 1) for k in range(60)]
    assert found(spark, same) == brute(same) != []


@pytest.mark.parametrize("scale", [3e5, 1e8, 1e30])
def test_beyond_float64(spark, scale):
    rows = made(40, random.Random(11), dim=3, scale=scale) + made(40, random.Random(12), dim=3)[20:]
    assert found(spark, rows) == brute(rows)


def test_products_are_exact():
    draw = np.random.default_rng(1)
    a, b = draw.integers(-(2**40), 2**40, (9, 5)).astype(float), draw.integers(-100, 100, (7, 5)).astype(float)
    a[3:] %= 1000
    got = products(a, b)
    assert [[int(x) for x in r] for r in got] == [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]


def test_running_lists_hold_ties():
    best = Running(2, 3)
    best.most = 4
    for at in range(0, 50, 5):
        ids = np.arange(at, at + 5)[::-1]
        best.add(np.arange(2), np.stack([np.zeros(5), (ids // 10).astype(float)]), np.ones((2, 5), bool), ids)
    q, scores, ids = best.cut()
    assert [*zip(q.tolist(), scores.tolist(), ids.tolist(), strict=True)] == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (1, 4, 40), (1, 4, 41), (1, 4, 42)]
    assert hard_negatives.SCALE == 256
