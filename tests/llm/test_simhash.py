import random
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loamwork.llm import simhash
from loamwork.llm.simhash import close_pairs, fingerprint, simhash_dedup


def plain_words(text):
    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    return [x for x in found.split(" ") if x]


def plain_shingles(text, size=3):
    w = plain_words(text)
    return [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def plain_fingerprint(text, size=3):
    shingles = plain_shingles(text, size)
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def alike(one, two, size, least):
    a, b = set(plain_shingles(one, size)), set(plain_shingles(two, size))
    return least is None or not (a or b) or len(a & b) / len(a | b) >= least


def plain_components(rows, radius=3, size=3, least=None):
    prints = [plain_fingerprint(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and alike(rows[i][1], rows[j][1], size, least):
                root[top(i)] = top(j)
    ids = [[rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None] for i in range(len(rows))]
    return sorted((str(r[0]), f"{p:016x}", str(min(c) if c else None)) for r, p, c in zip(rows, prints, ids, strict=True))


def corpus():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "dElta", "é", "straße", "zeta", "eta", "theta", "iota"]
    base = [[rng.choice(words) + str(rng.randrange(400)) for _ in range(rng.randrange(1, 300))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(60, 160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return rows + [(200, None), (201, ""), (202, " \n "), (203, "x" * 50_000), (None, "alone of its kind"), (7, rows[7][1]), (7, rows[7][1])]


def test_components_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component long").repartition(3)
    for tile in (None, 7):
        got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, tile=tile).collect())
        assert got == plain_components(rows)


def test_verified_links(spark):
    rng = random.Random(9)
    rows = []
    for k in range(25):
        w = [f"v{rng.randrange(3000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(w)))
        for c, changes in enumerate((1, 2, 40), 1):
            x = list(w)
            for at in rng.sample(range(200), changes):
                x[at] = "new"
            rows.append((10 * k + c, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash_dedup(docs, size=5, radius=10, least=0.8).collect()}
    assert got == {int(i): int(c) for i, _, c in plain_components(rows, 10, 5, 0.8)}
    assert all(got[10 * k + 1] == 10 * k and got[10 * k + 3] == 10 * k + 3 for k in range(25))


def test_fingerprint_of_long_and_odd_texts():
    long = " ".join(f"w{i % 977}" for i in range(3000))
    for text in (long, "one", "one two", "A\x0bB C", "ÀB c", None, "a a a a a a"):
        assert fingerprint(text) == plain_fingerprint(text)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 700, dtype=np.uint64)
    fps = np.unique(np.r_[fps, fps[:200] ^ np.uint64(0b1011), fps[:100] ^ np.uint64(1 << 60)])
    order = np.lexsort((fps, np.bitwise_count(fps)))
    fps = fps[order]
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 3}

    def classes(links):
        label = {int(f): int(f) for f in fps}
        for a, b in links:
            old, new = label[a], label[b]
            label.update({k: new for k, v in label.items() if v == old})
        return sorted(sorted(k for k in label if label[k] == v) for v in set(label.values()))

    cuts = [fps[i : i + 300] for i in range(0, len(fps), 300)]
    got = [x for i, a in enumerate(cuts) for j, b in enumerate(cuts) if i <= j for x in close_pairs(a, None if i == j else b, 3, 32)]
    assert classes(got) == classes(want)


def test_empty_table_and_other_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_dedup(docs).collect() == []
    with pytest.raises(TypeError):
        simhash_dedup(docs.selectExpr("'k' AS doc_id", "text"))


def template_rows():
    """Chains of texts: neighbours are some 0.8 alike or just below, so forests hold links that fail."""
    rng, rows = random.Random(21), []
    for k in range(6):
        w = [f"t{rng.randrange(3000)}" for _ in range(150)]
        for c in range(12):
            x = list(w)
            for at in rng.sample(range(150), rng.randrange(2, 7)):
                x[at] = f"slot{rng.randrange(10**6)}"
            rows.append((100 * k + c, " ".join(x)))
    loop = " ".join(["la la la la la la"] * 200)
    return rows + [(900, loop + " " + " ".join(f"a{i}" for i in range(9))), (901, loop + " " + " ".join(f"b{i}" for i in range(9)))]


def test_failed_links_take_no_other_with_them(spark):
    rows = template_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for tile in (None, 9):
        got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=14, tile=tile, least=0.8).collect())
        assert got == plain_components(rows, 14, 5, 0.8)


def test_links_that_stood_in_for_others(spark, monkeypatch):
    rows = template_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "linked_fingerprints", lambda prints, radius, tile: prints.sparkSession.createDataFrame([], "u long, v long"))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=14, least=0.8).collect())
    assert got == plain_components(rows, 14, 5, 0.8)


def alike_pairs():
    """Pairs of a similarity of 0.80 to 0.91, many further apart than ten bits."""
    rng, rows = random.Random(33), []
    for k in range(90):
        w = [f"p{rng.randrange(5000)}" for _ in range(200)]
        x = list(w)
        for at in range(k % 3 + 2):
            x[20 + 40 * at] = f"new{k}"
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(x))]
    return rows


def test_pipeline_stage_recalls_all_similar_texts(spark):
    import corpus_pipeline

    rows = alike_pairs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    want = plain_components(rows, 64, 5, 0.8)
    assert len({c for _, _, c in want}) == 90
    caught = sum(10 * k + 1 not in got for k in range(90))
    assert got == sorted(int(i) for i, _, c in want if i == c), f"{caught} of 90 pairs caught"


def grouped_rows():
    """Large groups of near copies, texts at the edge of being alike to some of them, and shorter ones of their words."""
    rng, rows = random.Random(77), []
    for k in range(3):
        w = [f"g{rng.randrange(2000)}" for _ in range(120)]
        for c in range(40):
            x = list(w)
            for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3, 4, 5, 6])):
                x[at] = f"slot{rng.randrange(10**6)}"
            if c % 9 == 0:
                x = x[: rng.randrange(90, 120)]
            rows.append((1000 * k + c, " ".join(x)))
    return rows + [(9000, None), (9001, " "), (9002, "\n")]


def test_parts_of_several_texts_meet_in_chunks(spark, monkeypatch):
    rows = grouped_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows, 64, 5, 0.8)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=6, least=0.8, beyond=True).collect()) == want
    monkeypatch.setattr(simhash, "missed_links", partial(simhash.missed_links, members=3, askers=2))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=2, least=0.8, beyond=True).collect()) == want
    close = plain_components(rows, 9, 5, 0.8)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=9, least=0.8).collect()) == close


def test_hot_shingles_are_compared_in_blocks(spark, monkeypatch):
    rows = grouped_rows() + alike_pairs()[:40]
    rows = [(i, (t or "") + " and all of these end in one passage of some words") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows, 64, 5, 0.8)
    monkeypatch.setattr(simhash, "HOT", 3)
    monkeypatch.setattr(simhash, "common_shingles", lambda docs, size: np.zeros(0, np.uint64))
    monkeypatch.setattr(simhash, "linked_fingerprints", lambda prints, radius, tile: prints.sparkSession.createDataFrame([], "u long, v long"))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=6, least=0.8, beyond=True).collect()) == want


def test_a_token_that_all_parts_have_takes_bounded_rows():
    n = 20_000
    shared = simhash._Shared(0.8, None)
    token, part = np.zeros(n, np.int64), np.arange(n)
    place = (np.linspace(10, 100_000, n).astype(np.int64) << 32) + 9  # sizes far apart, late in the prefix
    cols = [pa.array(c) for c in (token, place, part)]
    batches = [pa.RecordBatch.from_arrays([c.slice(k, 3000) for c in cols], ["token", "place", "part"]) for k in range(0, n, 3000)]
    made = [*shared.by_token(iter(batches))]
    blocks = -(-n // simhash.HOT)
    assert len(made) <= blocks * (blocks + 1) // 2 and all(b.num_rows == 1 for b in made)
    pairs = sum(b.num_rows for b in shared.by_block(pa.RecordBatch.from_arrays([b.column(3), b.column(4)], ["left", "right"]) for b in made[:3]))
    assert pairs > 0


def test_tables_of_one_word_sequence(spark):
    same = [(k, " ".join(["one two three four five six"]) + " " * k) for k in range(12_000)]
    for rows in ([(5, "lone text of a few words here")], same[:3], [(k, None if k % 2 else "") for k in range(4)], same, []):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.component_id) for r in simhash_dedup(docs, size=5, radius=10, least=0.8, beyond=True).collect()}
        first = min((i for i, _ in rows), default=None)
        assert got == {(i, first) for i, _ in rows}


def test_similar_texts_are_found_without_all_pairs_of_fingerprints(spark, monkeypatch):
    rows = alike_pairs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=10, least=0.8, beyond=True).collect())

    def never(*_, **__):
        raise AssertionError("compares all fingerprints")

    monkeypatch.setattr(simhash, "linked_fingerprints", never)
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=10, least=0.8, beyond=True).collect()) == want
    # what is proposed is no part of the result, only work that is spared
    monkeypatch.setattr(simhash, "proposed_links", lambda prints, radius: prints.sparkSession.createDataFrame([], "u long, v long"))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in simhash_dedup(docs, size=5, radius=10, least=0.8, beyond=True).collect()) == want


def test_proposed_links_are_close_and_join_what_lies_together(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(300)]
    near = [f ^ (1 << rng.randrange(64)) for f in base]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in base + near})
    prints = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    links = [tuple(r) for r in simhash.proposed_links(prints, 3).collect()]
    assert all(u in set(signed) and v in set(signed) and ((u ^ v) & ((1 << 64) - 1)).bit_count() <= 3 for u, v in links)
    assert len(links) >= 0.95 * len(base)
    assert simhash.proposed_links(prints.where("false"), 3).collect() == []


def test_a_set_meets_a_part_of_several_sizes(spark):
    # of the part only the set of 14 may be alike to that of 13: 12 of 15 are in both, and of their prefixes one; those of 12 and of 15 would need two
    sets = [(1, 13, [1, 10, 11]), (2, 12, [4, 5, 10]), (2, 14, [2, 3, 10]), (2, 15, [6, 7, 10, 12])]
    rows = [(part, 0, n, np.array(p, np.uint64).tobytes()) for part, n, p in sets]
    met = simhash.met_parts(spark.createDataFrame(rows, "part long, fp long, n long, prefix binary"), 0.8, None)
    assert [tuple(r) for r in met.collect()] == [(1, 2)]


def test_no_size_of_a_part_needs_fewer_shingles_than_are_asked_for():
    shared = simhash._Shared(0.8, None)
    for a in range(1, 40):
        for low in range(int(0.8 * a), int(a / 0.8) + 1):
            for high in range(low, int(a / 0.8) + 3):
                true = [b for b in range(low, high + 1) if min(a, b) >= 0.8 * max(a, b) - 1e-9]
                if true:
                    one, two = ([np.array([x]) for x in row] for row in ((a, a, 0, 1, 0), (low, high, -1, 2, 0)))
                    asked = shared.checked(one, two).column(2)[0].as_py()
                    assert asked <= min(float(shared.needed(a, b)) for b in true), (a, low, high)
