"""Operators on small tables made here, against plain Python or stated results."""

import random

import pytest
from pyspark.sql import functions as F

from loamwork.functions import text as tx
from loamwork.functions.vectors import cosine, scaled
from loamwork.operators import context, dedup, joins, lifecycle, logs, metrics, retrieval, segments
from loamwork.operators.graph import connected_components


def one(spark, column, **values):
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**values)]).select(column.alias("x")).first().x


def test_text_scalars(spark):
    c = F.col("t")
    cases = [
        (tx.title(c), "\n  plain\n## Head  \nx", "Head"),
        (tx.title(c), "\n  first line \nsecond", "first line"),
        (tx.title(c), " \n ", None),
        (tx.lexical_tokens(c), "Use --dry-run /etc/Hosts v1.2", ["use", "dry-run", "etc/hosts", "v1.2", "dry", "run", "etc", "hosts", "v1", "2"]),
        (tx.fact_tokens(c), "v1.21.4 (1.21.4), 30s 8080 8080/tcp 3rd x86_64 2024-03-01.", ["1.21.4", "2024-03-01", "30s", "8080/tcp"]),
        (tx.citations(c, F.lit(3)), "a [2] b [1] c [2] d [9] e[x]", [1, 2]),
        (tx.literals(c), "run `a b` with --flag and /x/y", ["a b", "--flag", "/x/y"]),
        (tx.snippet(c, 12), "**bold** words here and there", "bold words…"),
        (tx.category(c), " Concept ", "concept"),
        (tx.category(c), "essay", "other"),
        (tx.line_range(c, F.lit(2), F.lit(3)), "a\nb\nc\nd", "b\nc"),
        (tx.line_range(c, F.lit(3), F.lit(2)), "a\nb\nc\nd", ""),
        (tx.cut_long_line(c, 1), "x" * 130, ["x" * 64, "x" * 64, "xx"]),
        (tx.rendered("{t}!{u}", t=c, u=F.lit("{t}")), "a", "a!{t}"),
        (tx.distinctive_tokens(c), "The river, THE River a-b=c of", ["river", "a-b=c"]),
    ]
    for column, text, want in cases:
        assert one(spark, column, t=text) == want, text


@pytest.mark.parametrize(
    "answer, want",
    [
        ("Not in the knowledge base.", True), ("**not in the knowledge base**", True), ("1. \"Not in the knowledge base\"", True),
        ("\"Not in the knowledge base\" is what it says when", False), ("It is not in the knowledge base", False), ("", False),
    ],
)
def test_abstained(spark, answer, want):
    assert one(spark, tx.abstained(F.col("t")), t=answer) is want


def test_vectors(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[2.0, 0.0]) == 1
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 2.0]) == 0
    assert one(spark, scaled(F.col("a"), 10.0), a=[3.0, 4.0]) == [6.0, 8.0]


def hits(spark, scores, **more):
    rows = [(1, k, k, s, *[v[k] for v in more.values()]) for k, s in enumerate(scores)]
    return spark.createDataFrame(rows, ["q_id", "id", "rank", "score", *more])


@pytest.mark.parametrize("scores, at", [([0.9, 0.88, 0.3, 0.29], 2), ([0.9, 0.8, 0.7, 0.6], None), ([1.0, 0.1], None), ([0.5, 0.5, 0.5], None), ([1.0, 1.0, 0.999], None), ([0.9, 0.95, 0.2, 0.19], 2)])
def test_cliff(spark, scores, at):
    assert retrieval.cliff(hits(spark, scores)).first().cliff_at == at


def test_prime_moves_within_its_bounds(spark):
    def order(act, sitting=None):
        h = hits(spark, [1.0] * len(act), activation=[float(a) for a in act], sitting=sitting or [False] * len(act))
        return [r.id for r in retrieval.prime(h).orderBy("rank").collect()]

    assert order([0, 0, 0, 10]) == [0, 3, 1, 2]
    assert order([0, 10, 0, 0]) == [0, 1, 2, 3]
    assert order([0, 0, 0, 0, 10]) == [0, 1, 4, 2, 3]
    assert order([0, 10]) == [0, 1]
    assert order([0, 0, 0], [False, False, True]) == [0, 2, 1]


def plain_cap(rows, most, target):
    seen, kept, out = {}, [], []
    for i, keys in rows:
        if any(seen.get(k, 0) >= most for k in keys):
            out.append(i)
        else:
            for k in keys:
                seen[k] = seen.get(k, 0) + 1
            kept.append(i)
    return kept + out[: max(0, target - len(kept))]


def test_diversity_caps(spark):
    rng = random.Random(1)
    for _ in range(3):
        single = [(i, [rng.choice("abc")]) for i in range(12)]
        h = spark.createDataFrame([(1, i, i, 0.0, k[0], k) for i, k in single], "q_id long, id long, rank long, score double, g string, gs array<string>")
        want = plain_cap(single, 2, 8)
        assert [r.id for r in retrieval.diversity_cap(h, "g", 2, 8).orderBy("rank").collect()] == want
        assert [r.id for r in retrieval.diversity_cap_many(h, "gs", 2, 8).orderBy("rank").collect()] == want
    many = [(i, rng.sample("abcd", 2)) for i in range(10)]
    h = spark.createDataFrame([(1, i, i, k) for i, k in many], "q_id long, id long, rank long, gs array<string>")
    assert [r.id for r in retrieval.diversity_cap_many(h, "gs", 2, 7).orderBy("rank").collect()] == plain_cap(many, 2, 7)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (41, 40), (1, 0)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(42)) and all(got[100 + i] == 100 for i in range(30)) and 500 not in got


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 200))] for _ in range(25)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(25, 70):
        w = list(rng.choice(base[:6]))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "other"
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, rows[3][1]), (92, rows[3][1])]
    monkeypatch.setattr(dedup, "BLOCK", 4)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    sig = {r.id: r.s for r in docs.select("id", tx.signature(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    label = {i: i for i in sig}
    for i in sig:
        for j in sig:
            if i < j and dedup.estimate(sig[i], sig[j]) >= 0.9 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    got = dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and {r.id: r.class_id for r in got} == label


def test_capture(spark):
    old = spark.createDataFrame([(1, "known text here")], "id long, text string").withColumn("content_hash", F.sha2("text", 256))
    long = " ".join(f"w{k}" for k in range(300))
    new = spark.createDataFrame([(2, "  "), (3, "known text here"), (4, long), (5, long + " more"), (6, "unlike the rest"), (7, "unlike the rest")], "id long, text string")
    assert {r.id: r.status for r in dedup.capture(old, new).collect()} == {2: "rejected", 3: "duplicate", 4: "queued", 5: "needs_review", 6: "queued", 7: "duplicate"}


def test_pairs_and_lineage(spark):
    pairs = spark.createDataFrame([(3, 1, 0.5), (1, 3, 0.9), (2, 2, 1.0), (4, 5, 0.7)], "a_id long, b_id long, score double")
    assert sorted(map(tuple, dedup.canonical_pairs(pairs).collect())) == [(1, 3, 0.9), (4, 5, 0.7)]
    moved = spark.createDataFrame([(4, 1), (5, 1), (3, 9)], "old_id long, new_id long")
    assert sorted(map(tuple, dedup.repoint_pairs(pairs, moved).collect())) == [(1, 9, 0.9)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "child_id long, root_id long")
    tree = dedup.lineage(edges, spark.createDataFrame([(1,)], "id long")).collect()
    assert sorted((r.node, r.parent, r.depth) for r in tree if r.parent) == [(2, 1, 1), (3, 1, 1)]


def test_asof_and_nearest_with_null_scopes_and_ties(spark):
    rng = random.Random(6)
    make = lambda n, first: [(first + k, rng.randrange(300), rng.choice([None, 1, 2])) for k in range(n)]
    left, right = make(60, 0), make(80, 1000)
    shape = "id long, at long, scope long"
    lf, rf = spark.createDataFrame(left, shape), spark.createDataFrame(right, shape)
    back, near = {}, {}
    for i, at, s in left:
        mine = [(a, r) for r, a, t in right if t == s]
        back[i] = max([(a, r) for a, r in mine if 0 <= at - a <= 20], default=(None, None))[1]
        near[i] = min([(abs(at - a), r) for a, r in mine if abs(at - a) <= 20], default=(None, None))[1]
    assert {r.id: r.right_id for r in joins.asof_backward(lf, rf, "scope", 20).collect()} == back
    assert {r.id: r.right_id for r in joins.nearest(lf, rf, "scope", 20).collect()} == near


def test_coalesced_keystrokes(spark):
    rows = [(1, "ui", None, 0, "fa", 1), (2, "ui", None, 3, "fat", 1), (3, "ui", None, 5, "fat32", 2), (4, "ui", None, 6, "fat", 1), (5, "ui", None, 40, "fat32", 1), (6, "ui", 1, 41, "fat32x", 1), (7, "ui", 1, 42, "fat32xy", 0)]
    ev = spark.createDataFrame(rows, "id long, door string, scope long, at long, query string, pool long")
    assert sorted(r.id for r in logs.coalesce_queries(ev).collect()) == [3, 5, 6, 7]


def test_links_activation_and_decisions(spark):
    shown = spark.createDataFrame([(1, 5, 0), (1, 7, 1), (1, 7, 2), (2, 7, 0), (2, 5, 1)], "event_id long, id long, rank long")
    assert [tuple(r) for r in logs.hebbian_links(shown).collect()] == [(5, 7, 2.0, 2)]
    old = spark.createDataFrame([(5, 7, 4.0, 0)], "a_id long, b_id long, weight double, bumped_at long")
    assert logs.hebbian_links(shown, old, 30 * 86400).first().weight == 4.0
    verdicts = spark.createDataFrame([(1, 7, 0), (2, 99, 0)], "event_id long, expected long, at long")
    links, act = logs.verdict_bumps(verdicts, shown)
    assert [tuple(r) for r in links.collect()] == [(5, 7, 2.0)] and act.count() == 2
    state = dict(answered=False, engaged=2, strong_engaged=True, refined=0, abandoned=False, abstained=False, engagement=3.0, pivots=0, returns=0)
    for change, want in (({}, "satisfied"), ({"pivots": 1}, "generate"), ({"abandoned": True}, "generate"), ({"engaged": 1}, "promote"), ({"engaged": 0, "strong_engaged": False}, "unsatisfied"), ({"answered": True}, "satisfied"), ({"engagement": 1.0, "refined": 2}, "unsatisfied")):
        assert one(spark, logs.decide(), **(state | change)) == want, change


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "rank int")
    assert tuple(metrics.retrieval_metrics(empty).first()) == (0, 0.0, 0.0)
    q = spark.createDataFrame([], "expected array<long>, cited array<long>")
    assert metrics.citation_recall(q).first()[0] == 1.0
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    assert metrics.link_threshold(v).first()[0] == 0.55


def test_lifecycle_guards(spark):
    art = spark.createDataFrame([(1, None, None), (2, "deprecated", None), (3, "superseded", 1), (4, "superseded", 77), (5, None, None)], "id long, status string, superseded_by long").withColumn("corpus_id", F.lit(1))
    sup = lifecycle.supersede(art, spark.createDataFrame([(1, 5), (5, 2), (3, 5)], "id long, winner_id long"))
    assert {r.id: (r.status, r.superseded_by) for r in sup.collect()} == {1: ("superseded", 5), 2: ("deprecated", None), 3: ("superseded", 1), 4: ("superseded", 77), 5: (None, None)}
    assert {r.id: r.status for r in lifecycle.healed(art).collect()}[4] == "active"
    assert {r.id: r.status for r in lifecycle.deprecate(art, spark.createDataFrame([(1,), (3,)], "id long")).collect()} == {1: "deprecated", 2: "deprecated", 3: "superseded", 4: "superseded", 5: None}


def test_segments_cover_every_line():
    text = "# Top\n\n" + "\n".join(f"line {k} of the first part" + ("\n" if k % 9 == 0 else "") for k in range(60)) + "\n## Next\n" + "\n".join(f"more of it {k}" for k in range(30)) + "\n" + "x" * 2000
    for budget in (64, 128, 4096):
        parts = segments.split_segments(text, budget)
        body = [line for p in parts for line in p.text.split("\n")[p.carried :]]
        assert "".join(body) == text.replace("\n", "")
        assert parts[0].start == 1 and parts[-1].end == len(text.splitlines())
        assert all(a.end <= b.start for a, b in zip(parts, parts[1:], strict=False)) or budget == 64
    small = segments.split_segments(text, 64)
    assert any(p.carried and p.text.startswith("# Top") for p in small) and any(p.text.startswith("## Next") for p in small)
    titles = [p.title for p in segments.split_passages(segments.split_segments(text, 4096)[0], 64)]
    assert titles[0] == "Top" and titles[-1] == "Next"
    assert segments.split_segments(None) == [] and segments.split_segments(" \n") == []


def test_literals():
    text = "Run `make all` in ~/src, see and/or\n```\ncode line\n```\n    indented = 1\nuse --force (/etc/x.conf)."
    assert segments.literals(text) == ["make all", "~/src", "code line", "indented = 1", "--force", "/etc/x.conf"]
    assert segments.missing_literals(text, "make  all ~/src code line --force") == ["indented = 1", "/etc/x.conf"]
    assert segments.split_paragraphs("aaaa\n\nbbbb\n\n" + "c" * 100, 10) == ["aaaa\n\nbbbb", "c" * 64, "c" * 36]


def test_situations(spark):
    rows = [(1, 1704470400, "a", '{"tz":"Europe/Vienna","viewport_w":390.0,"viewport_h":844.0,"network":"wifi"}'), (2, 1704470400, None, "not json"), (3, 1704470400, "b", None)]
    df = spark.createDataFrame(rows, "id long, at long, scope string, bundle string")
    got = {r.id: r.v for r in df.select("id", context.encode(F.col("at"), F.col("scope"), context.parsed(F.col("bundle"))).alias("v")).collect()}
    assert all(len(v) == context.SIZE for v in got.values())
    assert abs(sum(x * x for x in got[1][:8]) - 100) < 1e-6 and got[2][:8] == [0.0] * 8
    assert abs(sum(x * y for x, y in zip(got[1][:8], got[3][:8], strict=True))) < 90
    hour = 17 + 0 / 60  # 16:00 UTC in Vienna
    import math

    assert abs(got[1][8] - math.sin(2 * math.pi * hour / 24)) < 1e-9 and abs(got[2][8] - math.sin(2 * math.pi * 16 / 24)) < 1e-9
    assert got[1][10:17].index(1.0) == 4


def test_a_situation_reads_its_bundle_once(spark):
    df = spark.range(3).select(F.lit(1704470400).alias("at"), F.lit("a").alias("scope"), F.concat(F.lit('{"tz":"Europe/Vienna","viewport_w":1.0,"viewport_h":1.0,"dpr":'), F.col("id").cast("string"), F.lit("}")).alias("bundle"))
    encoded = df.select(context.encode(F.col("at"), F.col("scope"), context.parsed(F.col("bundle"))).alias("v"))
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 2 and plan.count("from_utc_timestamp(") == 1
    assert len({tuple(r.v) for r in encoded.collect()}) >= 2


def plain_clusters(vectors, weights, merge_at, most):
    """From the rule: join the nearest above the line, else begin one; while there are too many, the two nearest become one. Lists of members."""
    import numpy as np

    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    mid = lambda c: sum(weights[k] * vectors[k] for k in c) / sum(weights[k] for k in c)
    held = []
    for k in range(len(vectors)):
        if weights[k] <= 0:
            continue
        near = [(cos(mid(c), vectors[k]), n) for n, c in enumerate(held)]
        if near and max(near)[0] > merge_at:
            held[max(near)[1]].append(k)
            continue
        held.append([k])
        if len(held) > most:
            _, i, j = max((cos(mid(a), mid(b)), -i, -j) for i, a in enumerate(held) for j, b in enumerate(held) if i < j)
            held[-i] += held.pop(-j)
    return held


def test_profiles_against_the_rule(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    middles = rng.normal(size=(4, 6))
    rows = []
    for k in range(240):
        v = middles[rng.integers(4)] + rng.normal(0, 0.5, 6)
        rows.append((int(rng.integers(3)), [None, 1][rng.integers(2)], k, int(rng.integers(500)), float(rng.choice([0.0, 0.5, 1.0, 2.0])), v.tolist()))
    df = spark.createDataFrame(rows, "artifact_id long, scope long, id long, at long, weight double, vector array<double>").repartition(3)
    got = {(r.artifact_id, r.scope, r.events, r.last_at, r.representative): (r.weight, r.centroid) for r in context.profiles(df, 0.7, 3, 1.5, 99).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[2]))
        vectors, weights = [np.array(r[5]) for r in own], [r[4] for r in own]
        for c in plain_clusters(vectors, weights, 0.7, 3):
            total = sum(weights[k] for k in c)
            mid = sum(weights[k] * vectors[k] for k in c) / total
            best = max(c, key=lambda k: (round(float(vectors[k] @ mid / np.linalg.norm(vectors[k]) / np.linalg.norm(mid)), 9), -own[k][3], -own[k][2]))
            if total >= 1.5:
                want[(*key, len(c), max(own[k][3] for k in c), own[best][2])] = (total, mid.tolist())
    assert got.keys() == want.keys()
    for k, (w, m) in got.items():
        assert np.isclose(w, want[k][0]) and np.allclose(m, want[k][1])


def test_segments_by_their_rules():
    """Each window against a plain reading of the rules, line after line."""
    rng = random.Random(1)
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(1, 50)):
            lines.append(rng.choice(["", "  ", "# head", "## next", "x" * rng.randrange(1, 90), "y" * rng.randrange(1, 20), "z" * 300]))
        budget = rng.choice([20, 40, 90])
        text = "\n".join(lines)
        if segments.tokens(text) <= budget or not text.strip():
            continue
        parts = [p for x in segments.lines_of(text) for p in segments.pieces(x, budget)]
        cost = lambda a, b: sum(segments.tokens(x) + 1 for x in parts[a:b])
        cuts = segments._cuts(parts, budget)
        assert [c[0] for c in cuts] == [0, *[c[1] for c in cuts[:-1]]] and cuts[-1][1] == len(parts)
        took = 0  # up to where lines were let in without a look at the budget
        for a, b, _ in cuts[:-1]:
            if segments.is_heading(parts[b]) and cost(a, b) <= budget:
                continue  # ended by a heading that would run over, or cut at one
            ended_blank = not parts[b - 1].strip()
            assert ended_blank or segments.is_heading(parts[b]) or cost(a, b) >= budget, (a, b)
            took = b
        for (a, b, carried) in cuts:
            if carried >= 0:
                assert carried < b and segments.is_heading(parts[carried])
        assert took <= len(parts)


def test_lines_end_at_line_feeds_alone():
    assert segments.lines_of("a\x0cb\u2028c\r\nd\x85\n") == ["a\x0cb\u2028c", "d\x85"]
    assert segments.lines_of("a\n\nb\r") == ["a", "", "b\r"] and segments.lines_of("") == []
    (whole,) = segments.split_segments("a\x0cb\nc\u2028d")
    assert (whole.start, whole.end) == (1, 2)


def test_runs_go_on_over_stretches(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice(["ui", "api"]), rng.choice([None, 1]), rng.randrange(40) * 43_200 + rng.randrange(20), rng.choice(["a", "ab", "abc", "b"]), rng.randrange(2)) for k in range(200)]
    ev = spark.createDataFrame(rows, "id long, door string, scope long, at long, query string, pool long").repartition(3)
    for gap in (10, 50_000):
        one, two = (sorted(r.id for r in logs.coalesce_queries(ev, gap, days).collect()) for days in (1, 10_000))
        assert one == two and len(one) < 200
        one, two = (sorted((r.id, r.session) for r in logs.sessions(ev, gap, "scope", days).collect()) for days in (1, 10_000))
        assert one == two


def test_pursuits(spark):
    shape = "event_id long, scope long, at long, query string, vector array<double>"
    vectors = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [1.0, 0.01]]
    searches = spark.createDataFrame([(k, 1, at, "q", v, False, c) for k, (at, v, c) in enumerate([(100, vectors[0], None), (160, vectors[1], 7), (170, vectors[2], None), (900, vectors[3], None), (5, vectors[0], None)])], shape + ", answered boolean, confirmed long")
    asks = spark.createDataFrame([(50, 2, 130, "a", vectors[2], True), (51, 2, 130, "a", [], True)], shape + ", abstained boolean")
    acts = spark.createDataFrame([(1, 7, 1, "opened", 165, 0.0, 0.9, True), (2, 8, 1, "opened", 171, 0.0, 0.9, True), (3, 9, 2, "opened", 2000, 0.0, 0.9, True)], "id long, artifact_id long, scope long, kind string, at long, seconds double, similarity double, shown boolean")
    got = {r.need: r for r in logs.pursuit_sweep(searches, asks, acts, 2100, 100, after=50).collect()}
    assert {k: (r.n_searches, r.engaged, r.opened_at, r.last_at) for k, r in got.items()} == {"0:0": (2, 1, 100, 160), "0:1": (1, 0, 900, 900), "2:0": (2, 1, 130, 170)}
    assert got["0:0"].decision == "promote" and got["0:1"].decision == "unsatisfied" and got["2:0"].abstained
    assert logs.pursuit_sweep(searches, asks, acts, 2050, 100, after=50).collect() == []  # something came in 50 seconds ago
    assert logs.pursuit_sweep(searches, asks, acts, 9000, 100, after=8000).collect() == []
