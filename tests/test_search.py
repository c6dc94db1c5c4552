"""Scans, composed searches and their parts against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.functions import text as tx
from loamwork.operators import dedup, joins, retrieval, search, tiles
from loamwork.operators.graph import connected_components
from loamwork.storage import materialise

ODD = [None, "", "  ", "a-b c", "-x- /y/", "v1.2.3_z", "É-ü ß ſ", "x" * 41 + " y", "é" * 21, "a--b", "İx Ω", "1/2 ½ ²", "tab\tand\nline", "_" * 5, "日本語-テスト"]


def plain_best(corpus, queries, k, floor=None, skip_self=False):
    out = []
    for q, a in queries:
        if a is None:
            continue
        best = {}
        for i, b in corpus:
            if skip_self and i == q:
                continue
            good = b is not None and len(b) == len(a) and np.linalg.norm(b) and np.linalg.norm(a)
            s = round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6) + 0.0 if good else 0.0
            if floor is None or s >= floor:
                best[i] = max(best.get(i, -9), s)
        out += [(q, i, s) for i, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return sorted(out)


@pytest.mark.parametrize("tile", [3, 2048])
def test_scans_keep_the_best_of_each_query(spark, tile):
    rng = np.random.default_rng(2)
    vector = lambda: rng.integers(-2, 3, 4).astype(float).tolist()  # noqa: E731  small integers make ties
    corpus = [(int(rng.integers(40)), vector()) for _ in range(90)] + [(50, None), (51, [1.0]), (52, [0.0] * 4), (53, [1.0, None, 0.0, 2.0])]
    queries = [(k, vector()) for k in range(12)] + [(30, None), (31, [0.0] * 4)]
    c = spark.createDataFrame(corpus, "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame(queries, "q_id long, vector array<double>")
    plain = [(i, None if v is None else [x or 0.0 for x in v]) for i, v in corpus]
    for k, floor, skip in ((3, None, False), (5, 0.5, True), (200, None, False)):
        for block in (64, 1 << 20):
            got = retrieval.cosine_scan(c, q, k, floor, skip, block, tile).groupBy("q_id", "id").agg(F.max("score").alias("score"))
            best = retrieval.ranked(got, F.desc("score"), "id", limit=k).select("q_id", "id", "score")
            assert sorted(tuple(r) for r in best.collect()) == plain_best(plain, queries, k, floor, skip)
    assert retrieval.cosine_scan(c, q.where("false"), 3).collect() == []
    assert retrieval.cosine_scan(c.where("false"), q, 3).collect() == []


def test_terms_and_signatures_are_those_of_the_column_forms(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["ab", "c-d", "E.f", "x/y_z", "9", "Öl"]) for _ in range(rng.randrange(1, 200))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    t = F.coalesce("text", F.lit(""))
    want = {r.id: r for r in docs.select("id", tx.lexical_tokens(t).alias("terms"), tx.signature(t).alias("sig")).collect()}
    assert all(retrieval.terms_of(x) == want[i].terms for i, x in enumerate(texts))
    got = {(r.id, r.term): r.tf for r in retrieval.postings(docs).collect()}
    assert got == {(i, w): r.terms.count(w) for i, r in want.items() for w in r.terms}
    some = {(r.id, r.term) for r in retrieval.postings(docs, only=frozenset(["ab", "c-d"])).collect()}
    assert some == {k for k in got if k[1] in ("ab", "c-d")}
    assert {r.id: r.sig for r in dedup.signatures(docs).collect()} == {i: r.sig for i, r in want.items()}


def test_many_query_terms_go_by_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} w{i % 7} common") for i in range(60)], "id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(9)], "q_id long, text string")
    one = sorted(map(tuple, retrieval.bm25_topk(docs, queries, 4).collect()))
    monkeypatch.setattr(retrieval, "WEIGHTS", 3)
    assert sorted(map(tuple, retrieval.bm25_topk(docs, queries, 4).collect())) == one
    monkeypatch.setattr(retrieval, "TERMS", 3)
    assert sorted(map(tuple, retrieval.bm25_topk(docs, queries, 4).collect())) == one and one


def test_tiles_are_dealt_to_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(64)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    monkeypatch.setattr(tiles, "TILE_BYTES", 64)
    own = materialise(retrieval.cosine_tiles(vectors, 4), "dealt-tiles")
    for block in (1 << 20, 1000):
        met = tiles.meet(own, own, block)
        pairs = [(r.a_tile, r.c_tile, r.p) for r in met.select("a_tile", "c_tile", F.spark_partition_id().alias("p")).collect()]
        assert len({p[:2] for p in pairs}) == len(pairs) == 16 * 16
        most = max(sum(p == q for *_, p in pairs) for q in {p for *_, p in pairs})
        assert most <= 128, (block, most)


def test_queries_meet_tiles_of_posting_lists(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(n))
    # ids repeat, some are null, and frequent words are in most of the documents
    rows = [(None if i % 50 == 7 else i % 300, text(rng.randrange(0, 30)) if i % 40 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, text(rng.randrange(0, 6))) for i in range(50)] + [(0, "w1 w2"), (99, "nowhere")], "q_id long, text string")
    want = sorted(map(tuple, retrieval.bm25_topk(docs, queries, 5).collect()))
    monkeypatch.setattr(retrieval, "WEIGHTS", 3)
    monkeypatch.setattr(retrieval, "saturated", lambda tf: 1 / 0)  # terms are not joined
    for docs_, postings_, block, groups in ((32_768, 4_000_000, 32_768, 64), (40, 4_000_000, 16, 3), (1000, 300, 7, 64)):
        for name, value in (("TILE_DOCS", docs_), ("TILE_POSTINGS", postings_), ("BLOCK_QUERIES", block), ("GROUPS", groups)):
            monkeypatch.setattr(retrieval, name, value)
        assert sorted(map(tuple, retrieval.bm25_topk(docs, queries, 5).collect())) == want and len(want) > 150
    assert retrieval.bm25_topk(docs.where("false"), queries, 5).collect() == []


def test_containment_of_sets(spark):
    rng = random.Random(5)
    for size in (3, 9):
        sets = {i: {rng.randrange(12) for _ in range(rng.randrange(0, size))} for i in range(60)}
        rows = [(i, m) for i, of in sets.items() for m in of]
        df = spark.createDataFrame(rows + rows[:20], "id long, member long").repartition(3)
        for tested in (1, 2, 3):
            got = {tuple(r) for r in joins.set_containment(df, df, tested).collect()}
            assert got == {(a, b) for a in sets for b in sets if a != b and sets[b] and sets[b] <= sets[a]}
    assert joins.set_containment(df.where("false"), df).collect() == [] == joins.set_containment(df, df.where("false")).collect()


def test_best_overlap_in_blocks(spark):
    rng = random.Random(7)
    span = lambda: (lambda a: (a, a + rng.randrange(0, 40)))(rng.randrange(1, 120))
    passages = [(i, rng.randrange(3), *span()) for i in range(60)]
    spans = [(100 + i, rng.randrange(3), *span(), i % 5) for i in range(60)]
    want = {}
    for i, doc, a, b in passages:
        over = [(min(b, e) - max(a, s) + 1, -o, k) for k, d, s, e, o in spans if d == doc]
        over = [x for x in over if x[0] * 2 > b - a + 1]
        if over:
            want[i] = max(over)[2]
    p = spark.createDataFrame(passages, "passage_id long, doc_id long, start_line long, end_line long")
    s = spark.createDataFrame(spans, "artifact_id long, doc_id long, start_line long, end_line long, ordinal long")
    for width in (1, 7, 64):
        assert {r.passage_id: r.artifact_id for r in joins.best_overlap(p, s, width).collect()} == want


def base(spark):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(30)]
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(words, 12))
        rows.append((i, i % 4, text, rng.normal(size=5).tolist(), ["pinned"] if i % 11 == 0 else [], "deprecated" if i % 13 == 5 else None, None, i, 1000 - i))
    return rows, spark.createDataFrame(rows, "id long, corpus_id long, text string, vector array<double>, tags array<string>, status string, superseded_by long, ordinal long, verified_at long")


def test_a_query_without_terms_goes_by_its_vector(spark):
    rows, art = base(spark)
    queries = spark.createDataFrame([(1, "word1 word2", rows[3][3]), (2, "!!", rows[5][3]), (3, "  ", rows[5][3])], "q_id long, text string, vector array<double>")
    got = search.search(art, queries, 1000, limit=4)
    by = {}
    for r in got.orderBy("q_id", "rank").collect():
        by.setdefault(r.q_id, []).append(r)
    assert set(by) == {1, 2} and all(len(v) == 4 for v in by.values())
    assert all(r.similarity is not None for r in by[2]) and not any(rows[r.id][5] for v in by.values() for r in v)
    links = spark.createDataFrame([(by[2][0].id, 30, 9.0, 1000), (by[2][0].id, 5, 9.0, 1000)], "a_id long, b_id long, weight double, bumped_at long")
    more = search.search(art, queries, 1000, limit=4, cap=2, links=links, scorer=retrieval.overlap_scorer(), activation=art.select("id", F.lit(0.0).alias("activation"), F.lit(False).alias("sitting")))
    recalled = [r for r in more.where("q_id = 2").collect() if r.associated]
    assert [r.rank for r in recalled] == [4 + k for k in range(len(recalled))] and all(r.id in (30, 5) for r in recalled)


def test_rounds_of_questions(spark):
    rows, art = base(spark)
    parts = spark.createDataFrame([(q, p, f"word{q + p} word{2 * q + 7}", rows[q + p][3]) for q in range(4) for p in range(2)], "q_id long, part long, text string, vector array<double>")
    links = spark.createDataFrame([(i, (i * 7) % 40, 3.0 + i, 1000) for i in range(20) if i != (i * 7) % 40], "a_id long, b_id long, weight double, bumped_at long")
    keyed = parts.select((F.col("q_id") * 16 + F.col("part")).alias("q_id"), "text", "vector")
    found = {}
    for r in search.search(art, keyed, 1000, 8).orderBy("rank").collect():
        found.setdefault(r.q_id, []).append((r.id, r.score))
    live = [r for r in rows if r[5] is None]
    rounds = []
    for key, hits in found.items():
        gaps = [max(0.0, round(a[1] - b[1], 9)) for a, b in zip(hits, hits[1:], strict=False)]
        cut = None
        if len(hits) >= 3:
            top = max(gaps)
            if top > 0 and top > 0.01 * abs(hits[0][1]) and round(top - 3.0 * (sum(gaps) - top) / (len(gaps) - 1), 9) > 0:
                cut = gaps.index(top) + 1
        ids = [i for i, _ in hits][:cut]
        reached = []
        for via in ids[:3]:
            row = rows[via]
            same = sorted((r[7], r[0]) for r in live if r[1] == row[1])
            at = same.index((row[7], via))
            near = [same[at - 1][1]] if at else []
            near += [same[at + 1][1]] if at + 1 < len(same) else []
            linked = sorted([(-(3.0 + i), (i * 7) % 40) for i in range(20) if i == via and i != (i * 7) % 40] + [(-(3.0 + i), i) for i in range(20) if (i * 7) % 40 == via and i != via])
            reached += near + [o for _, o in linked[:6]]
        fresh = [i for i in dict.fromkeys(reached) if i not in ids and rows[i][5] is None][:6]
        rounds.append((key // 16, key % 16, cut, ids, fresh))
    want = {}
    for q in {r[0] for r in rounds}:
        keyed_rows = []
        for _, part, cut, ids, fresh in (r for r in rounds if r[0] == q):
            keyed_rows += [((0 if k < (3 if cut is None else cut) else 1), k, part, i, "ranked") for k, i in enumerate(ids)]
            keyed_rows += [(2, k, part, i, "reached") for k, i in enumerate(fresh)]
        seen = {}
        for row in sorted(keyed_rows):
            seen.setdefault(row[3], row[4])
        want[q] = list(seen.items())
    got = {}
    for r in search.ask_rounds(art, parts, links, 1000).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append((r.id, r.kind))
    assert got == want


def test_small_rules(spark):
    assert [search.candidate_width(10, *a) for a in ((), (True,), (False, True), (False, False, 50))] == [10, 30, 30, 50]
    doors = spark.createDataFrame([("ui",), ("judge",), ("extension",), (None,)], "d string").select(search.captured(F.col("d")).alias("c"), search.claimed_door(F.col("d")).alias("k")).collect()
    assert [tuple(r) for r in doors] == [(True, "api"), (False, "api"), (True, "extension"), (False, "api")]
    texts = spark.createDataFrame([(1, "a  b"), (2, " a b "), (3, "c")], "q_id long, text string")
    got = {r.q_id: r.vector for r in search.query_vectors(texts, lambda t: F.array(F.char_length(t).cast("double"))).collect()}
    assert got == {1: [3.0], 2: [3.0], 3: [1.0]}
    _, art = base(spark)
    assert search.random_artifact(art, 3, 2).collect() == search.random_artifact(art.repartition(2), 3, 2).collect()


@pytest.mark.parametrize("block, tile", [(1 << 20, 2048), (600, 5)])
def test_links_and_counts_over_all_pairs(spark, block, tile):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-2, 3, 3).astype(float).tolist()) for k in range(60)] + [(70, None), (71, [0.0] * 3), (72, [1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    cos = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and a is not None and b is not None:
                x, y = np.array(a), np.array(b)
                good = len(a) == len(b) and np.linalg.norm(x) * np.linalg.norm(y) > 0
                cos[i, j] = round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6) + 0.0 if good else 0.0
    counts = {round(r.score, 6): r.n for r in retrieval.cosine_counts(df, block, tile).collect()}
    assert counts == Counter(cos.values())
    for floor in (0.95, 0.99):
        root = {i: i for i, _ in rows}

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for (i, j), s in cos.items():
            if s >= floor:
                a, b = sorted((top(i), top(j)))
                root[b] = a
        found = retrieval.cosine_links(df, floor, block, tile)
        got = {r.node: r.component for r in connected_components(found).collect()}
        assert got == {i: top(i) for i in root if any(top(j) == top(i) for j in root if j != i)} and len(set(got.values())) > 3
    assert retrieval.cosine_links(df.where("false"), 0.5).collect() == [] == retrieval.cosine_counts(df.where("false")).collect()


def test_reranked_scores_round_halves_by_their_product(spark):
    hits = spark.createDataFrame([(1, 10, 0, 0.000249, 0), (1, 11, 1, 0.000049, 3), (1, 12, 2, 0.5, 0)], "q_id long, id long, rank long, score double, j long")
    got = {r.id: r.score for r in retrieval.rerank(hits, F.col("score") * 0.5 + F.col("j") / 10.0).collect()}
    # DuckDB's round(x, 6) of 0.0001245, 0.30002449999999997 and 0.25
    assert got == {10: 0.000124, 11: 0.300025, 12: 0.25}


def test_signatures_go_once_for_the_same_nodes(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(dedup, "materialise", lambda df, label: (out := materialise(df, label), sizes.update({label: out.count()}))[0])
    word = lambda k: f"w{k}"
    # three near copies of one text, two of another, one alone
    texts = [" ".join(map(word, range(s, s + n))) for s, n in ((0, 300), (0, 301), (0, 302), (1000, 300), (1000, 301), (5000, 300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    want = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert {r.id: r.class_id for r in dedup.near_duplicates(docs).collect()} == want
    # hashes that the same three or two nodes share lie in one block; one for each hash would be some twenty
    assert sizes["near-blocks"] <= 5
    monkeypatch.setattr(dedup, "BLOCK", 1)
    assert {r.id: r.class_id for r in dedup.near_duplicates(docs).collect()} == want


def test_only_what_comes_near_the_line_is_looked_at(monkeypatch):
    rng = np.random.default_rng(6)
    one, two = retrieval._unit(rng.normal(size=(40, 8))), retrieval._unit(rng.normal(size=(4000, 8)))
    seen, add = [], retrieval._Best.add
    monkeypatch.setattr(retrieval._Best, "add", lambda self, first, scores, ids: (seen.append(scores.size), add(self, first, scores, ids))[1])
    for floor in (None, 0.7):
        best, plain = retrieval._Best(40, 5), retrieval._Best(40, 5)
        seen.clear()
        for k in range(0, 4000, 50):
            best.put(0, one @ two[k : k + 50].T, np.arange(40), np.arange(k, k + 50), floor, True)
        assert sum(seen) < 40 * 4000 / 4
        scores = np.round(one @ two.T, 6) + 0.0
        scores[np.arange(40), np.arange(40)] = -np.inf
        scores[scores < (floor or -1)] = -np.inf
        add(plain, 0, scores, np.arange(4000))
        assert all((a == b).all() for a, b in zip(best.cut(), plain.cut(), strict=True))
