"""Queries over whole tables that SQL is too slow for, against brute force over a small fixture."""

import hashlib
import random

import numpy as np

from loamwork.plans import catalogue


def parts(edges):
    root = {n: n for e in edges for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in root}


def test_whole_tables_match_brute_force(spark, tmp_path):
    rng = random.Random(4)
    lines = [(rng.randrange(40), rng.randrange(1, 90), rng.randrange(1, 12), rng.choice([0.0, 0.1]), 0.08, float(rng.randrange(1, 51))) for _ in range(70)]
    orders = [(k, 1 + k % 17) for k in range(40)]
    vectors = np.random.default_rng(5).normal(size=(30, 12))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    run = lambda name: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())

    customer = dict(orders)
    assert run("components") == sorted(parts([(customer[x[0]], x[2] + 1000000) for x in lines]).items())

    of = parts([(x[1], x[2] + 1000000) for x in lines])
    best = {c: max((n % 97, n) for n in of if of[n] == c)[1] for c in of.values()}
    assert run("keepers") == sorted((n, best[c], n != best[c]) for n, c in of.items())

    sets = {}
    for x in lines:
        sets.setdefault(x[0], set()).add(x[1])
    got = {(a, b) for a, b in run("set_containment") if a != b}
    assert got == {(a, b) for a in sets for b in sets if a != b and sets[b] <= sets[a]}

    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = [(a, b) for a in range(30) for b in range(a) if round(float(unit[a] @ unit[b]), 6) >= 0.4]
    groups = {}
    for n, c in parts(near).items():
        groups.setdefault(c, []).append(n)
    assert run("gap_clusters") == sorted((hashlib.sha256(",".join(map(str, sorted(g))).encode()).hexdigest(), len(g)) for g in groups.values())

    # every pair of a part and a supplier that a line names, as its ends in order; those in pending pairs that hang together with a supplier's number
    spark.createDataFrame([(k,) for k in range(1, 12)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    ends = {tuple(sorted((x[1], x[2] * 7 + 1))) for x in lines if x[1] != x[2] * 7 + 1}
    pending = [(a, b) for a, b in ends if b % 4]
    of = parts(pending)
    asked = {of[k] for k in range(1, 12) if k in of}
    assert run("open_component") == sorted(p for p in pending if of[p[0]] in asked)
