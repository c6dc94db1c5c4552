"""Sweeps and records on small tables."""

import json

from pyspark.sql import functions as F

from loamwork.operators import sweeps


def test_groups_hold_together_through_what_is_hidden(spark):
    art = [(1, 5, None, None), (2, 9, "deprecated", None), (3, 7, None, None), (4, 7, None, None), (5, 1, None, None), (6, 1, None, None), (8, 2, None, None), (9, 3, "superseded", 4)]
    pairs = [(1, 2, "near_identical"), (2, 3, "near_identical"), (3, 4, "near_identical"), (5, 7, "near_identical"), (6, 8, "pending"), (8, 99, "pending")]
    after, filed = sweeps.consolidated(spark.createDataFrame(art, "id long, created_at long, status string, superseded_by long"), spark.createDataFrame(pairs, "a_id long, b_id long, state string"))
    got = {r.id: (r.status, r.superseded_by) for r in after.collect()}
    # of 1, 3 and 4 the newest stays, the larger id of equals; 2 only holds them together
    assert got == {1: ("superseded", 4), 2: ("deprecated", None), 3: ("superseded", 4), 4: (None, None), 5: (None, None), 6: (None, None), 8: (None, None), 9: ("superseded", 4)}
    assert {(r.a_id, r.b_id): r.state for r in filed.collect()} == {(1, 2): "no_conflict", (2, 3): "no_conflict", (3, 4): "no_conflict", (5, 7): "no_conflict", (6, 8): "pending", (8, 99): "pending"}
    again, still = sweeps.consolidated(after, filed)
    assert {r.id: (r.status, r.superseded_by) for r in again.collect()} == got and sorted(map(tuple, still.collect())) == sorted(map(tuple, filed.collect()))


def test_repairs_find_what_was_interrupted(spark):
    art = spark.createDataFrame([(1, None, None, "embedded"), (2, "superseded", 77, "embedded"), (3, None, None, "pending"), (4, "superseded", 1, "failed")], "id long, status string, superseded_by long, embed_state string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    jobs = spark.createDataFrame([(1, 2, 0), (2, 0, 0), (3, 1, 95)], "id long, class long, queued_at long")
    coverage = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id long, gap_id long")
    got = sorted(map(tuple, sweeps.repairs(art, ids(1), ids(1, 3, 50), jobs, ids(10), coverage, 100, 20).collect()))
    assert got == [("aged", 1), ("no_point", 2), ("no_row", 50), ("revived", 2), ("uncovered", 2), ("unrelated", 3)]


def test_records(spark):
    events = spark.createDataFrame([(1, "q", 5, None), (2, "r", 6, 9), (3, "s", 7, None)], "event_id long, query string, at long, judged_at long")
    pool = spark.createDataFrame([(1, 7, 1, True), (1, 8, 0, True), (2, 7, 0, False)], "event_id long, id long, rank long, shown boolean")
    got = {r.event_id: ([(c.rank, c.id, c.shown) for c in r.pool], r.pending, r.expected_rank) for r in sweeps.hydrated(events, pool, spark.createDataFrame([(1, 7), (2, 99)], "event_id long, id long")).collect()}
    assert got == {1: ([(0, 8, True), (1, 7, True)], True, 1), 2: ([(0, 7, False)], False, None), 3: ([], True, None)}
    art = spark.createDataFrame([(1, '["a", null, "b"]'), (2, "no"), (3, None), (4, '{"a": 1}'), (5, '["x"]')], "id long, caveats string")
    assert {r.id: r.caveats for r in sweeps.caveats_of(art, art.where("id < 5")).collect()} == {1: ["a", "b"], 2: [], 3: [], 4: [], }
    known = spark.createDataFrame([], "id string, opened_at long, queries string, state string")
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "opened_at long, queries string")
    once = sweeps.filed_pursuits(known, new)
    assert once.count() == 2
    key = once.where("opened_at = 1").first().id
    done = sweeps.closed_pursuits(once, spark.createDataFrame([(key, "dropped", 33)], "id string, state string, artifact_id long"), 50)
    assert sorted((r.opened_at, r.state, r.closed_at) for r in done.collect()) == [(1, "generated", 50), (2, "open", None)]
    assert sweeps.filed_pursuits(done.select(*known.columns), new).where("state = 'generated'").count() == 1
    docs = spark.createDataFrame([(1, "  " + "n" * 3000 + " ", " t ", "f.pdf", "application/pdf", 9), (2, " \n", "", None, None, None)], "id long, note string, title string, file_name string, mime string, bytes long")
    one, two = (json.loads(r.metadata) for r in sweeps.captured_with(docs).orderBy("id").collect())
    assert one == {"note": "n" * 2000, "title": "t", "file": {"name": "f.pdf", "type": "application/pdf", "size": 9}} and two == {}
    assert sweeps.captured_with(docs.where(F.lit(False))).collect() == []


def test_points_without_a_row_are_told_however_many_parts_there_are(spark, tmp_path):
    from loamwork.plans.sweeping import repaired

    parts = [(k, 1, "p", "Brand#11") for k in (1, 2, 7, 1000001, 1000002, 1000003, 1000007)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 3, 9)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,)], "n_nationkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(r.id for r in repaired(spark, str(tmp_path)).where("kind = 'no_row'").collect())
    assert got == [1000001, 1000002, 1000003, 1000009]
