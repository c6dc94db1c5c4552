import zlib
from collections import defaultdict

from loamwork.llm.shard import shard_documents


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_matches_the_published_walk(spark):
    ids = [None, None, 0, 1, 1, -5, 2**62, -(2**63), *range(10, 600)]
    rows = [(i, None if k % 9 == 0 else "é" * (k % 5), 1) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    for n in (1, 3, 40):
        out = shard_documents(docs, n).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in out) == sorted(
            (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", jump(i or 0, n), jump(i or 0, n + 1)) for i, t, _ in rows
        )
        slots = defaultdict(list)
        for r in out:
            assert r.grown_shard in (r.shard, n)
            slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32)))
        for of in slots.values():
            assert [s for s, _ in sorted(of)] == list(range(len(of)))
            assert [o for _, o in sorted(of)] == sorted(o for _, o in of)


def test_empty_and_text_keys(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = shard_documents(spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string"), 5).collect()
    assert len(out) == 2 and all(0 <= r.shard < 5 for r in out)
