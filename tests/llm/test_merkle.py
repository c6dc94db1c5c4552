import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loamwork.llm import merkle
from loamwork.llm.merkle import Fractal, depth_of, digest, fold, manifest

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, leaf string, id int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    for row in tree[:-1]:
        yield at, (row[at ^ 1] if at ^ 1 < len(row) else None)
        at //= 2


def brute(rows):
    def leaf(r, more=0):
        r = (*r[:3], r[3] + more if r[3] is not None else None, r[4])
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {name: levels([x[2] for x in sorted(trees[name], key=lambda x: x[:3])]) for name in names}
    top = levels([built[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(trees[name], key=lambda x: x[:3])):
            path = [*siblings(built[name], at), *siblings(top, k)]
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for place, other in path:
                node = sha(node if other is None else other + node if place % 2 else node + other)
            out.append((r[0], own, top[0][k], top[-1][0], sha("".join(o for _, o in path if o)), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], SHAPE).repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = manifest(docs, found={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, **more)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("n", [*range(1, 40), 64, 65, 100])
@pytest.mark.parametrize("height", [1, 2, 3])
def test_traversal_emits_each_path(n, height):
    leaves = [sha(str(k)).encode() for k in range(n)]
    for depth in {depth_of(n, 20), 7}:  # 7: a last block of a larger tree is raised to the common level
        tree = [leaves]
        for _ in range(depth):
            tree.append([digest(*tree[-1][k : k + 2]) for k in range(0, len(tree[-1]), 2)])
        walk = Fractal(leaves, depth, height)
        assert walk.root() == tree[-1][0]
        walk.hashed = 0
        paths = [*walk.paths()]
        for at, (sides, others) in enumerate(paths):
            want = [tree[k][(at >> k) ^ 1] for k in range(depth) if (at >> k) ^ 1 < len(tree[k])]
            assert others == b"".join(want)
            assert fold(leaves[at], sides, others) == tree[-1][0]


def test_traversal_is_bounded():
    leaves = [sha(str(k)).encode() for k in range(4096)]
    walk = Fractal(leaves, 12, 4)
    assert sum(1 for _ in walk.paths()) == 4096
    assert walk.most_held < 3 * 2 * 2**5 + 3 * 13  # two subtrees of 30 nodes a level and their stacks, of 8190 nodes in all
    assert walk.hashed < 3.1 * 4096


def test_as_brute_force(spark):
    draw = random.Random(2)
    rows = [(k, draw.choice(["web", None]), draw.choice(["en"] * 12 + ["de", "é", "", None]), draw.choice([None, k, 5]), draw.choice([None, "", "é" * k, "text"])) for k in range(230)]
    rows += [(999, None, "one", 1, "lone leaf"), rows[5], rows[5], (7, "other", "en", 1, "same id"), (None, None, None, None, None), (None, None, "en", 3, "x"), (-4, "a", "en", 0, "z")]
    draw.shuffle(rows)
    assert found(spark, rows) == brute(rows)
    for depth in (1, 3):  # many stages
        assert found(spark, rows[:90], depth=depth) == brute(rows[:90])


def test_small_and_empty_tables(spark):
    assert found(spark, []) == []
    for n in (1, 2, 3):
        rows = [(k, "s", None, 1, "t") for k in range(n)]
        assert found(spark, rows) == brute(rows)
    many = [(k, "s", f"lang{k:03}", 1, "t") for k in range(30)]  # a tree each
    assert found(spark, many, depth=2) == brute(many)
    assert merkle.DEPTH == 10
