import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loamwork.llm.exact_dedup import exact_dedup
from loamwork.llm.line_dedup import line_dedup
from loamwork.llm.runs import LogIndex, RunIndex

ROWS = [(i, f"text {i % 7}\n{'x' * (i % 3)}") for i in range(40)] + [
    (50, None), (51, ""), (52, " "), (53, "\t\n"), (54, "a  b"), (55, "a\nb"), (55, "a b"), (None, "a b"), (None, "lone"), (60, "é" * 70_000), (60, "é" * 70_000),
]


def plain_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out, kept = [], set()
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        first = i == keep and n not in kept
        kept |= {n} if first else set()
        out.append((str(i), str(keep), len(ids), first, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_exact_dedup(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in ROWS], "doc_id long, text string, digest string").repartition(3)
    shapes = [
        {},
        {"memtable_rows": 4, "index_memtable": 3, "fanout": 2},
        {"digest": lambda t: F.unhex(F.lit("aabbccdd")), "width": 4},  # every text collides
        {"digest": lambda t: F.unhex(F.repeat(F.substring(F.sha2(t, 256), 1, 2), 4)), "width": 4, "memtable_rows": 5},
        {"memtable_rows": 4, "filter_bytes": 1},
    ]
    for shape in shapes:
        got = sorted((str(r[0]), str(r[1]), *r[2:]) for r in exact_dedup(docs, **shape).collect())
        assert got == plain_exact(ROWS), shape
    assert exact_dedup(docs.where("false")).collect() == []


def plain_lines(rows, at_least=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= at_least)]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    rows = [
        (1, "Menu\nown 1\n\nmenu "), (2, "\tMENU\nown 2"), (3, "menu"), (4, None), (5, ""), (6, "\n\n"), (7, "ÉTÉ\nété"), (8, "été"), (9, "été\nMenu\r"), (9, "été\nMenu\r"),
        (None, "same"), (None, "same"), (12, "same\nsame"), (13, "z" * 100_000 + "\nsame"), (14, "twice\ntwice\ntwice"),
    ]
    docs = spark.createDataFrame([(i, t, 5, "h") for i, t in rows], "doc_id long, text string, n_lines int, hash string").repartition(3)
    for shape in ({}, {"broadcast_hashes": 0}, {"memtable": 2, "fanout": 2}):
        out = line_dedup(docs, min_docs=3, **shape)
        got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())
        assert got == plain_lines(rows), shape
        assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in out.collect())
    assert line_dedup(docs.where("false")).collect() == []


def test_run_index_against_a_dictionary():
    rng = np.random.default_rng(1)

    def add(a, b):
        out = a.copy()
        out["n"] += b["n"]
        return out

    index, want = RunIndex(4, np.dtype([("n", "i8")]), add, memtable=50, fanout=3), Counter()
    for _ in range(60):
        raw = [bytes(rng.integers(0, 4, 4, dtype=np.uint8)) for _ in range(rng.integers(1, 30))]
        payload = np.ones(len(raw), [("n", "i8")])
        index.add(np.array(raw, "S4"), payload)
        want.update(raw)
    keys, payload = index.compacted()
    assert dict(zip([k.ljust(4, b"\0") for k in keys.tolist()], payload["n"].tolist(), strict=True)) == dict(want)
    assert [len(level) for level in index.levels] == [1]


def test_log_index_keeps_its_runs_and_the_smallest():
    rng = np.random.default_rng(2)
    kind = [("id", "i8"), ("n", "i8")]

    def smallest(a, b):
        out = a.copy()
        out["id"], out["n"] = np.minimum(a["id"], b["id"]), a["n"] + b["n"]
        return out

    index, want, seen = LogIndex(4, np.dtype(kind), smallest, memtable=40, fanout=3), {}, []
    for _ in range(50):
        raw = [bytes(rng.integers(1, 4, 4, dtype=np.uint8)) for _ in range(rng.integers(1, 30))]
        payload = np.zeros(len(raw), kind)
        payload["id"], payload["n"] = rng.integers(0, 10**6, len(raw)), 1
        for k, i in zip(raw, payload["id"].tolist(), strict=True):
            low, n = want.get(k, (i, 0))
            want[k] = (min(low, i), n + 1)
        index.add(np.array(raw, "S4"), payload)
        for run in [r for level in index.levels for r in level]:
            if not any(run is r for r, _, _ in seen):
                seen.append((run, run.keys.copy(), run.payload.copy()))
    assert len(seen) > 10 and any(len(level) > 1 for level in index.levels)
    index.flush()
    there, found = index.get(np.array([*want, b"\xff\xff\xff\xff"], "S4"))
    assert there.tolist() == [True] * len(want) + [False]
    assert [tuple(x) for x in found[:-1].tolist()] == [*want.values()]
    keys, payload = index.compacted()
    assert {k: tuple(p) for k, p in zip(keys.tolist(), payload.tolist(), strict=True)} == want and [len(x) for x in index.levels] == [1]
    # no run was ever changed
    assert all((r.keys == k).all() and (r.payload == p).all() and not r.payload.flags.writeable for r, k, p in seen)
