import itertools
import random
import time

from loamwork.operators import logs
from loamwork.sources.generations import Generations
from loamwork.streaming import logs as live
from loamwork.streaming.replay import cursor, learn_links, learned_links
from loamwork.streaming.sittings import Carried, carried, stream_sittings


def run(query_frame, name, spark):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_sessions_match_the_batch_form(spark, tmp_path):
    rows = [(k, 1_700_000_000 + t, k % 2) for k, t in enumerate([0, 5, 100, 1200, 1300, 3000, 3100, 9000])] + [(99, 1_700_090_000, 7)]
    ev = spark.createDataFrame(rows, "id long, at long, scope long").selectExpr("*", "timestamp_seconds(at) AS ts")
    ev.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev")
    got = run(live.stream_sessions(stream, "900 seconds", "1 second"), "sessions_out", spark)
    want = logs.sessions(ev, 899).groupBy("scope", "session").agg({"id": "count"}).where("scope <> 7")
    assert sorted(r.n for r in got.where("scope <> 7").collect()) == sorted(r[2] for r in want.collect())


def test_keystrokes_fold_as_they_come(spark, tmp_path):
    rows = [(1, "ui", "s", 1_700_000_000, "fa", 1), (2, "ui", "s", 1_700_000_003, "fat", 1), (3, "ui", "s", 1_700_000_050, "dog", 1), (4, "ui", "t", 1_700_000_001, "cat", 1), (9, "ui", "end", 1_700_009_000, "x", 1)]
    ev = spark.createDataFrame(rows, "id long, door string, scope string, at long, query string, pool long")
    ev.coalesce(1).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev")
    got = run(live.stream_coalesced(stream, 15, "1 second"), "keys_out", spark)
    assert {r.id for r in got.collect()} >= {2}
    assert {r.id for r in got.collect()} <= {r.id for r in logs.coalesce_queries(ev).collect()}


def event_files(spark, rows, shape, folder, parts):
    """Each part a file, in the order of their names."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], shape).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)


def test_links_are_learned_once(spark, tmp_path):
    draw = random.Random(6)
    rows = [(k, 1_700_000_000 + 7 * k, [draw.randrange(12) for _ in range(draw.randrange(5))]) for k in range(120)]
    stream = event_files(spark, rows, "event_id long, at long, ids array<long>", f"{tmp_path}/ev", 6)
    store = Generations(spark, f"file://{tmp_path}/links")
    real, calls = learn_links(store, 2.0), []

    def dies(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            batch.limit(0).selectExpr("1 AS a").write.parquet(f"{store.folder}/g{batch_id + 1}")  # began, and died before its manifest
            raise RuntimeError("killed")
        real(batch, batch_id)
        if len(calls) == 5:
            raise RuntimeError("killed")  # after its own commit, before the stream's

    for _ in range(3):
        q = stream.writeStream.foreachBatch(dies).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            pass
    assert calls == [0, 1, 1, 2, 3, 3, 4, 5] and cursor(store) == rows[-1][1]
    at, want = rows[-1][1] + 86400, {}
    for _, t, ids in rows:
        for a, b in itertools.combinations(sorted(set(ids)), 2):
            w, n = want.get((a, b), (0, 0))
            want[a, b] = (w + 2 * 2 ** (-(at - t) / 86400 / 30), n + 1)
    got = {(r.a_id, r.b_id): (r.weight, r.n_events) for r in learned_links(store, at).collect()}
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()}
    assert all(abs(got[k][0] - w) < 1e-5 for k, (w, _) in want.items())


def test_carried_folds_typing():
    held = Carried()
    for q in ("E", "E0", "E01", "E0", " ", "E01 mounting", "other", "E01", "E01 mounting", "x", "other"):
        held.take(None, q)
    assert held.queries == ["other", "x", "E01 mounting"]
    for k in [*range(30), 25]:
        held.take(k, None)
    assert held.touched == [25, 29, 28, 27, 26, *range(24, 9, -1)]


def test_sittings_as_state_equal_the_table(spark, tmp_path):
    draw, at = random.Random(2), 1_700_000_000
    words, rows = ["disk", "disk full", "di", "net", "", "net down now"], []
    for k in range(10_000):
        at += draw.choice((0, 1, 2, 2, 5))
        asks = draw.random() < 0.4
        scope = "hot" if k % 3 == 0 else f"s{draw.randrange(80)}"
        rows.append((scope, k, at, None if asks else draw.randrange(60), draw.choice(words) if asks else None))
    shape = "scope string, id long, at long, artifact_id long, query string"
    idle = 60
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = stream_sittings(event_files(spark, [*rows, ("end", 10**6, at + 10**6, 1, None), ("end", 10**6 + 1, at + 2 * 10**6, 1, None)], shape, f"{tmp_path}/ev", 4), idle)
    seen = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ended = {(r.scope, r.last_at): (list(r.touched), list(r.queries)) for r in seen if not r.open and r.scope != "end"}
    want = {(r.scope, r.last_at): (list(r.touched), list(r.queries)) for r in carried(spark.createDataFrame(rows, shape), idle).collect()}
    assert len(want) > 300 and ended == want
    assert max(len(r.touched) for r in seen) == 20
