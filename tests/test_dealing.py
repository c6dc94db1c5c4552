"""Work is cut by its rows, not by the session's number of shuffle partitions."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamwork.operators import dealing, derived, lifecycle, logs, retrieval
from loamwork.plans import catalogue


def test_links_and_cues_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 100)
    # 300 events of 4 things each: 1200 rows, 12 tasks, where the session has 4
    shown = spark.range(300).select(F.col("id").alias("event_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank")).withColumn("id", (F.col("event_id") % 30) * 4 + F.col("rank"))
    asked = spark.range(300).select(F.col("id").alias("event_id"), F.concat(F.lit("q"), (F.col("id") % 2).cast("string")).alias("query"))
    links = logs.hebbian_links(shown)
    assert links.rdd.getNumPartitions() == 12
    assert {(r.weight, r.n_events) for r in links.collect()} == {(10.0, 10)} and links.count() == 180
    cues = logs.link_cues(shown, asked)
    assert cues.rdd.getNumPartitions() == 12
    assert {(r.queries, tuple(map(tuple, r.cues))) for r in cues.collect()} == {(1, (("q0", 10),)), (1, (("q1", 10),))} and cues.count() == 180
    moved = spark.createDataFrame([(1, 0)], "old_id long, new_id long")
    one = logs.carried_cues(cues, moved, parts=12)
    two = lifecycle.carry_links(links.withColumn("bumped_at", F.lit(0)).withColumn("state", F.lit("learning")), moved, 0, parts=12)
    assert one.rdd.getNumPartitions() == two.rdd.getNumPartitions() == 12
    assert one.count() == two.count() == 177
    # with many moved ends both sides are dealt, and nothing changes
    monkeypatch.setattr(dealing, "FEW", 0)
    again = logs.carried_cues(cues, moved, parts=12)
    assert sorted(map(str, again.collect())) == sorted(map(str, one.collect()))


def test_slices_are_small_and_whole():
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["x"] * 1000)], ["id", "text"])
    parts = list(dealing.sliced([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [256, 256, 256, 232] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    # of long rows fewer go together, of rows beyond the bound one
    long = pa.record_batch([pa.array(range(6)), pa.array(["x" * 1000] * 6)], ["id", "text"])
    assert [p.num_rows for p in dealing.sliced([long], most=2100)] == [2, 2, 2]
    assert [p.num_rows for p in dealing.sliced([long], most=10)] == [1] * 6


def test_documents_are_scored_in_small_steps(monkeypatch):
    class Shared:
        value = (np.arange(2), {"a": 0, "b": 1}, np.array([[1.0, 0.5], [0.5, 1.0]]))

    widths, add = [], retrieval._Best.add
    monkeypatch.setattr(retrieval._Best, "add", lambda self, first, scores, ids: (widths.append(len(ids)), add(self, first, scores, ids))[1])
    batch = pa.record_batch([pa.array(range(3000)), pa.array([["a"], ["b"]] * 1500), pa.array([[1], [1]] * 1500)], ["id", "terms", "tfs"])
    (found,) = retrieval._scored(Shared, 2)(iter([batch]))
    assert sum(widths) == 3000 and max(widths) <= 1024
    assert found.to_pylist() == [{"q_id": q, "id": k, "score": 1.0} for q, k in ((0, 0), (0, 2), (1, 1), (1, 3))]


def test_trees_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 20)
    # of things 10 to 19 written through 100 to 109, the odd ones of which have no rows of their own
    rows = [(k, 1000 + 10 * k + r, 100 + k - 10) for k in range(10, 20) for r in range(10)] + [(100 + k, 5000 + k, None) for k in range(0, 10, 2)]
    sources = spark.createDataFrame(rows, "child_id long, root_id long, via long")
    trees = derived.lineage_tree(sources, spark.range(10, 20))
    assert trees.rdd.getNumPartitions() == 6  # 105 rows, where the session has 4
    want = {(k, 100 + k - 10, k, 1) for k in range(10, 20)} | {(k, 5000 + k - 10, 100 + k - 10, 2) for k in range(10, 20, 2)}
    want |= {(k, 1000 + 10 * k + r, 100 + k - 10, 2) for k in range(11, 20, 2) for r in range(10)}
    assert {(r.root, r.node, r.parent, r.depth) for r in trees.collect()} == want


def test_tiles_meet_in_small_steps():
    rng = np.random.default_rng(2)
    a, c = rng.normal(size=(7, 4)), rng.normal(size=(1100, 4))
    one = {"cell": 0, "a_tile": 0, "c_tile": 1, "a_n": 7, "c_n": 1100, "a_dim": 4, "c_dim": 4, "a_ids": np.arange(7).tobytes(), "c_ids": np.arange(1100).tobytes(), "a_rows": a.tobytes(), "c_rows": c.tobytes()}
    batch = pa.RecordBatch.from_pylist([one, one | {"a_dim": 2, "a_rows": a[:, :2].tobytes()}])
    found = list(retrieval._met(iter([batch]), step=retrieval.SCAN_ROWS))
    assert [s.shape[1] for _, _, _, s in found] == [512, 512, 76] * 2
    assert np.concatenate([two for _, _, two, _ in found[:3]]).tolist() == list(range(1100))
    assert np.allclose(np.concatenate([s for _, _, _, s in found[:3]], axis=1), a @ c.T, atol=1e-6) and not any(s.any() for _, _, _, s in found[3:])
    whole = list(retrieval._met(iter([batch])))
    assert [s.shape for _, _, _, s in whole] == [(7, 1100)] * 2


def test_all_that_an_event_showed_is_linked(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(logs, "WIDE", 16)
    # an event of 45 things, each twice, one of three of these, and one of a single thing
    lines = [(1, k, r) for r in range(2) for k in range(45)] + [(2, 44, 0), (2, 3, 1), (2, 20, 2), (3, 7, 0), (None, 1, 0), (None, 2, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(a, b): 1 for b in range(45) for a in range(b)}
    want |= dict.fromkeys([(3, 20), (3, 44), (20, 44)], 2)
    got = catalogue.QUERIES["hebbian_links"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a_id, r.b_id): r.n_events for r in got} == want
    left = catalogue.QUERIES["pruned_links"](spark, str(tmp_path)).collect()
    assert {(r.a_id, r.b_id) for r in left} == {p for p, n in want.items() if n * 2 ** (-(p[0] % 90) / 30) >= 0.5}
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    for name, rows in (("hebbian_links", got), ("pruned_links", left)):
        assert sorted((r[0], r[1]) for r in con.sql(f"select a_id, b_id from ({catalogue.SQL[name]})").fetchall()) == sorted((r.a_id, r.b_id) for r in rows)
