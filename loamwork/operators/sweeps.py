"""Sweeps over a whole base: near-identical artifacts brought down to one each, and what interrupted work left put right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators import dedup, reads
from loamwork.operators.lifecycle import healed
from loamwork.storage import materialise

NOTE = 2000


def _living() -> Column:
    return (F.coalesce("status", F.lit("active")) == "active") & F.col("superseded_by").isNull()


def consolidated(art: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts and pairs after a sweep over the pairs filed as near identical (a_id, b_id, state).

    art: (id, created_at, status, superseded_by). All filed pairs hold a group together, also through artifacts that are hidden or gone, but only living ones are
    members of it. Of two or more the keeper stays and the others point to it. Then each filed pair whose ends don't both live any more is closed as no conflict; other pairs keep their state.
    """
    filed = pairs.where("state = 'near_identical'")
    live = art.where(_living()).select("id", "created_at")
    moved = materialise(dedup.keepers(filed.select("a_id", "b_id"), live).where("superseded").select("id", "keeper_id"), "sweep-moved")
    after = art.join(moved, "id", "left")
    gone = F.col("keeper_id").isNotNull()
    after = after.withColumn("status", F.when(gone, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.coalesce("keeper_id", "superseded_by")).select(*art.columns)
    alive = live.select("id").join(moved.select("id"), "id", "left_anti")
    side = lambda p: alive.select(F.col("id").alias(f"{p}_id"), F.lit(True).alias(f"__{p}"))
    met = pairs.join(side("a"), "a_id", "left").join(side("b"), "b_id", "left")
    closed = (F.col("state") == "near_identical") & (F.col("__a").isNull() | F.col("__b").isNull())
    return after, met.withColumn("state", F.when(closed, "no_conflict").otherwise(F.col("state"))).select(*pairs.columns)


def repairs(art: DataFrame, related: DataFrame, points: DataFrame, jobs: DataFrame, gaps: DataFrame, coverage: DataFrame, now: int, wait: int, batch: int = 500) -> DataFrame:
    """(kind, id) of what an hourly repair puts right, each kind by the operator that does it.

    ``revived``: a row whose winner is gone; ``unrelated``: the first ``batch`` living rows that were never compared with others, as a sweep takes so many; ``no_point`` and ``no_row``: what
    only one of two stores has, of rows that say they are embedded; ``aged``: jobs that have waited longer than ``wait``; ``uncovered``: coverage of gaps that are gone.
    art: (id, status, superseded_by, embed_state); related, points, gaps: (id); jobs: (id, class, queued_at); coverage: (id, gap_id).
    """
    was, now_is = art.select("id", F.col("superseded_by").alias("__was")), healed(art).select("id", "superseded_by")
    revived = was.join(now_is, "id").where("__was is not null and superseded_by is null").select("id")
    asked = art.where(_living()).join(related.select("id"), "id", "left_anti").orderBy("id").limit(batch).select("id")
    drift = dedup.drift(art.where("embed_state = 'embedded'"), points.join(art.where("embed_state <> 'embedded'").select("id"), "id", "left_anti"))
    waiting = reads.aged(jobs, now, wait).select("id", F.col("class").alias("__new")).join(jobs, "id").where("__new < class").select("id")
    lost = reads.unsupported(coverage, gaps, "gap_id").select("id")
    tagged = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"))
    every = tagged(revived, "revived").unionByName(tagged(asked, "unrelated")).unionByName(drift.select(F.col("side").alias("kind"), F.col("id").cast("long").alias("id")))
    return every.unionByName(tagged(waiting, "aged")).unionByName(tagged(lost, "uncovered"))


def hydrated(events: DataFrame, candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """Search events (event_id, query, at, judged_at) with the pool each recorded, in its order, whether a verdict is pending, and where an expected artifact stood.

    candidates: (event_id, id, rank, shown), as many as the log's width; expected: (event_id, id). ``expected_rank`` is null where the pool didn't have it.
    """
    pool = candidates.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "shown"))).alias("pool"))
    place = candidates.join(expected.select("event_id", "id"), ["event_id", "id"]).groupBy("event_id").agg(F.min("rank").alias("expected_rank"))
    met = events.join(pool, "event_id", "left").join(place, "event_id", "left")
    return met.withColumn("pool", F.coalesce("pool", F.array().cast(pool.schema["pool"].dataType))).withColumn("pending", F.col("judged_at").isNull())


def caveats_of(art: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, caveats) of the asked artifacts; what is no JSON list of texts holds none."""
    listed = F.coalesce(F.from_json("caveats", "array<string>"), F.array().cast("array<string>"))
    return art.join(ids.select("id"), "id", "left_semi").select("id", F.array_compact(listed).alias("caveats"))


def pursuit_key(opened_at: Column, queries: Column) -> Column:
    """The same need has the same key, however often a sweep comes upon it."""
    return F.sha2(F.concat_ws("\n", opened_at.cast("string"), queries), 256)


def filed_pursuits(known: DataFrame, new: DataFrame) -> DataFrame:
    """Pursuits with those new ones (opened_at, queries) whose key is not there yet, open; what is there stays as it is. known: (id, opened_at, queries, state)."""
    keyed = new.select(pursuit_key(F.col("opened_at"), F.col("queries")).alias("id"), "opened_at", "queries", F.lit("open").alias("state")).dropDuplicates(["id"])
    return store_new(known, keyed)


def store_new(known: DataFrame, new: DataFrame) -> DataFrame:
    return known.unionByName(new.join(known.select("id"), "id", "left_anti").select(*known.columns))


def closed_pursuits(pursuits: DataFrame, closings: DataFrame, at: int) -> DataFrame:
    """Pursuits after closings (id, state, artifact_id): one that names an artifact was generated. Adds closed_at and artifact_id."""
    done = closings.select("id", F.when(F.col("artifact_id").isNotNull(), "generated").otherwise(F.col("state")).alias("__state"), "artifact_id", F.lit(at).cast("long").alias("closed_at"))
    met = pursuits.join(done, "id", "left")
    return met.withColumn("state", F.coalesce("__state", "state")).drop("__state")


def clean_note(note: Column) -> Column:
    """A note without white space around it, ``NOTE`` characters at most; null if nothing is left."""
    kept = F.substring(F.regexp_replace(note, r"(?U)^\s+|\s+$", ""), 1, NOTE)
    return F.when(kept != "", kept)


def captured_with(docs: DataFrame) -> DataFrame:
    """(id, metadata): what was given with a capture, as JSON without what wasn't given. docs: (id, note, title, file_name, mime, bytes)."""
    title = F.btrim("title")
    given = F.struct(clean_note(F.col("note")).alias("note"), F.when(title != "", title).alias("title"), F.when(F.col("file_name").isNotNull(), F.struct(F.col("file_name").alias("name"), F.col("mime").alias("type"), F.col("bytes").alias("size"))).alias("file"))
    return docs.select("id", F.to_json(given).alias("metadata"))
