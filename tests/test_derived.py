"""Undoing derived work, lineage trees, spliced lists and window contexts."""

import random

from pyspark.sql import functions as F

from loamwork.operators import derived


def test_two_supports_of_one_artifact(spark):
    edges = [(10, 1), (10, 2), (11, 1), (12, 10), (13, 11), (14, 11), (14, 12), (20, 3), (2, 0)]
    src = spark.createDataFrame(edges, "child_id long, root_id long")
    gone = lambda *ids: dict(derived.fates(src, spark.createDataFrame([(i,) for i in ids], "id long")).collect())
    assert gone(1) == {1: "forgotten", 10: "rederive", 11: "forgotten", 12: "rederive", 13: "forgotten", 14: "rederive"}
    assert gone(1, 2) == {1: "forgotten", 2: "forgotten", 10: "forgotten", 11: "forgotten", 12: "forgotten", 13: "forgotten", 14: "forgotten"}
    assert gone(10, 11) == {10: "forgotten", 11: "forgotten", 12: "forgotten", 13: "forgotten", 14: "forgotten"}  # a root never comes back
    assert gone(99) == {99: "forgotten"} and gone() == {}
    art = spark.createDataFrame([(i, None if i != 3 else "superseded", None if i != 3 else 11) for i in (0, 1, 2, 3, 10, 11, 12, 13, 14, 20)], "id long, status string, superseded_by long")
    left, kept, jobs = derived.forget_derived(art, src, spark.createDataFrame([(1,)], "id long"))
    assert sorted((r.id, r.status, r.superseded_by) for r in left.collect())[2] == (3, "active", None)  # what 11 replaced is back
    assert sorted(r.id for r in left.collect()) == [0, 2, 3, 10, 12, 14, 20]
    assert sorted(map(tuple, kept.collect())) == [(2, 0), (10, 2), (12, 10), (14, 12), (20, 3)]
    assert sorted(map(tuple, jobs.collect())) == [("rederive", 10), ("rederive", 12), ("rederive", 14)]


def test_fates_as_brute_force(spark):
    draw = random.Random(4)
    edges = [(c, draw.randrange(c)) for c in range(5, 90) for _ in range(draw.randrange(3))]
    roots = {1, 3, 40}
    gone = set(roots)
    while more := {c for c, r in edges if r in gone} - gone:
        gone |= more
    back = set()
    while more := {c for c, r in edges if c in gone - roots and (r not in gone or r in back)} - back:
        back |= more
    got = dict(derived.fates(spark.createDataFrame(edges, "child_id long, root_id long"), spark.createDataFrame([(i,) for i in roots], "id long")).collect())
    assert got == {i: "rederive" if i in back else "forgotten" for i in gone}


def test_tree_groups_by_what_sources_came_through(spark):
    rows = [(1, 100, None), (1, 101, 101), (1, 102, 2), (1, 103, 2), (1, 104, 3), (2, 102, None), (2, 103, 4), (4, 103, None), (4, 105, 2), (9, 1, None)]
    src = spark.createDataFrame(rows, "child_id long, root_id long, via long")
    tree = lambda **k: sorted(tuple(r)[1:] for r in derived.lineage_tree(src, spark.createDataFrame([(1,)], "id long"), **k).collect())
    assert tree() == [
        (2, 1, 1, 3, False), (3, 1, 1, 4, False), (4, 2, 2, 6, False), (100, 1, 1, 1, False), (101, 1, 1, 2, False), (102, 2, 2, 5, False), (103, 4, 3, 8, False), (104, 3, 2, 7, False),
    ]
    assert [(n, p) for n, _, _, p, cut in tree(most=3) if cut] == [(2, 3), (100, 1), (101, 2)]
    assert max(d for _, _, d, _, _ in tree(depth=2)) == 2 and all(cut for *_, cut in tree(depth=2))
    assert derived.lineage_tree(src, spark.createDataFrame([(77,)], "id long")).collect() == []


def test_spliced_lists_are_gapless(spark):
    rows = [("a", 0, 1, "x"), ("a", 5, 2, "y"), ("a", 9, 3, "z"), ("b", 0, 4, "w"), (None, 0, 5, "v")]
    parts = [(2, 0, "y0"), (2, 1, "y1"), (2, 2, "y2"), (3, 0, None), (4, 0, "w0")]
    out = derived.spliced(spark.createDataFrame(rows, "list_id string, ordinal long, id long, text string"), spark.createDataFrame(parts, "id long, part long, text string"))
    got = sorted((str(r.list_id), r.ordinal, r.id, r.part, r.origin, r.text) for r in out.collect() if r.list_id)
    assert got == [("a", 0, 1, None, None, "x"), ("a", 1, 2, 0, 2, "y0"), ("a", 2, 2, 1, 2, "y1"), ("a", 3, 2, 2, 2, "y2"), ("b", 0, 4, 0, 4, "w0")]


def plain_cut(text, budget, end):
    if not text or not budget:
        return None
    lines, kept, used = text.removesuffix("\n").split("\n"), [], 0
    for x in reversed(lines) if end else lines:
        used += len(x) * 2 // 7 + 1
        if used > budget:
            break
        kept.append(x)
    most = max(16, budget * 7 // 2)
    return "\n".join(reversed(kept) if end else kept) if kept else text[-most:] if end else text[:most]


def test_contexts_keep_to_their_budget(spark):
    draw = random.Random(8)
    texts = ["\n".join("é" * draw.randrange(40) for _ in range(draw.randrange(9))) for _ in range(60)] + ["x" * 500, "", "a\n", "\n\n", "short"]
    docs = spark.createDataFrame([(k % 3, k // 3, t) for k, t in enumerate(texts)], "doc_id long, idx long, text string")
    of = {(k % 3, k // 3): t for k, t in enumerate(texts)}
    for opening, overlap in ((30, 12), (0, 3), (5, 0)):
        for r in derived.window_context(docs, opening, overlap).collect():
            want = (plain_cut(of[r.doc_id, 0], opening, False) if r.idx else None, plain_cut(of.get((r.doc_id, r.idx - 1)), overlap, True), plain_cut(of.get((r.doc_id, r.idx + 1)), overlap, False))
            assert (r.opening, r.before, r.after) == want
            for text, budget in zip(want, (opening, overlap, overlap), strict=True):
                assert text is None or len(text) <= max(16, budget * 7 // 2) + 4 and sum(len(x) * 2 // 7 + 1 for x in text.split("\n")) <= max(budget, 5) + 1


def test_routes(spark):
    art = spark.createDataFrame([(k, k % 2, k, "x" * (2000 if k == 4 else 10)) for k in range(12)], "id long, corpus_id long, ordinal long, text string")
    got = {r.id: (r.route, r.batch) for r in derived.embed_routes(art, 100, 2).collect()}
    assert got[4] == ("split", None) and got[0] == got[2] == ("batch", 0) and got[6] == got[8] == ("batch", 1) and got[10] == ("batch", 2) and got[11] == ("batch", 2)
    assert derived.embed_routes(art.where(F.lit(False)), 100).collect() == []
