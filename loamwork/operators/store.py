"""Reads and small writes over a base's tables: each takes whole tables and returns the rows read, or the table after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.text import decayed, set_id
from loamwork.operators.joins import best_overlap, set_containment
from loamwork.operators.lifecycle import active

DIGITS = 6


def _marked(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``__hit``: whether a row's key is among the ids."""
    return table.join(ids.select(key, F.lit(True).alias("__hit")).distinct(), key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def set_where(table: DataFrame, ids: DataFrame, key: str = "id", **values: Column) -> DataFrame:
    """Sets columns of the rows that ids name; each value may read the row."""
    out = _marked(table, ids, key)
    for name, value in values.items():
        out = out.withColumn(name, F.when(F.col("__hit"), value).otherwise(F.col(name)))
    return out.select(*table.columns)


# Artifacts ------------------------------------------------------------------------------------------------------


def inserted(art: DataFrame, sources: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts and source rows after new ones (id, ..., via array of the artifacts it was written from).

    A written artifact has a source row for each transitive root of what it was written from; an artifact without sources is its own root.
    """
    drawn = new.select(F.col("id").alias("child_id"), F.explode("via").alias("via"))
    roots = sources.select(F.col("child_id").alias("via"), "root_id")
    rows = drawn.join(roots, "via", "left").select("child_id", F.coalesce("root_id", "via").alias("root_id"), "via")
    return art.unionByName(new.select(*art.columns)), sources.unionByName(rows.groupBy("child_id", "root_id").agg(F.min("via").alias("via")).select(*sources.columns))


def isolated(art: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pending embeddings that no job is going to make. jobs: (stage, target_id, state)."""
    armed = jobs.where("stage = 'embed' and state in ('pending', 'running')").select(F.col("target_id").alias("id"))
    return art.where("embed_state = 'pending'").join(armed, "id", "left_anti")


def never_related(art: DataFrame, jobs: DataFrame, n: int | None = None) -> DataFrame:
    """Embedded artifacts in results, passages aside, that were never asked to be related; the oldest ``n``."""
    asked = jobs.where("stage = 'relate'").select(F.col("target_id").alias("id"))
    out = art.where(active() & (F.col("embed_state") == "embedded") & (F.coalesce("provenance", F.lit("")) != "passage")).join(asked, "id", "left_anti")
    return out.orderBy("created_at", "id").limit(n) if n else out


def flagged(art: DataFrame, flags: DataFrame) -> DataFrame:
    """Artifacts with flags set (id, flags, note); an empty list clears them and their note."""
    f = flags.select("id", F.col("flags").alias("__f"), F.col("note").alias("__n"))
    joined = art.join(f, "id", "left")
    given = F.col("__f").isNotNull()
    return joined.withColumn("flags", F.when(given, F.array_distinct("__f")).otherwise(F.col("flags"))).withColumn("note", F.when(given & (F.size("__f") > 0), F.col("__n")).when(~given, F.col("note"))).select(*art.columns)


def dirtied(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with dirty raised where status or winner differ from before."""
    old = before.select("id", F.col("status").alias("__s"), F.col("superseded_by").alias("__w"), F.lit(True).alias("__known"))
    changed = F.col("__known") & ~(F.col("status").eqNullSafe(F.col("__s")) & F.col("superseded_by").eqNullSafe(F.col("__w")))
    return after.join(old, "id", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)) | F.coalesce(changed, F.lit(False))).select(*after.columns)


def roots_after_merge(art: DataFrame, sources: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, winner_id): what a finished merge hides: its roots in results, and older merges whose roots are all among its own. merges: (id)."""
    mine = sources.join(merges.select(F.col("id").alias("child_id")), "child_id", "left_semi").select(F.col("child_id").alias("id"), F.col("root_id").alias("member"))
    live = art.where(active()).select("id")
    roots = mine.select(F.col("member").alias("id"), F.col("id").alias("winner_id")).join(live, "id", "left_semi")
    others = art.where(active() & (F.col("provenance") == "merged")).select("id")
    theirs = sources.select(F.col("child_id").alias("id"), F.col("root_id").alias("member")).join(others, "id", "left_semi")
    subsumed = set_containment(mine, theirs).select(F.col("right_id").alias("id"), F.col("left_id").alias("winner_id"))
    return roots.unionByName(subsumed).groupBy("id").agg(F.min("winner_id").alias("winner_id"))


def merge_finished(art: DataFrame, sources: DataFrame, merges: DataFrame) -> DataFrame:
    """Artifacts after merges (id) in results are finished: roots and subsumed merges are superseded, and what a subsumed merge hid points to the new one."""
    alive = merges.join(art.where(active() & (F.col("provenance") == "merged")).select("id"), "id", "left_semi")
    hidden = roots_after_merge(art, sources, alive).join(alive.select("id"), "id", "left_anti")
    h = hidden.select("id", F.col("winner_id").alias("__w"))
    moved = hidden.select(F.col("id").alias("superseded_by"), F.col("winner_id").alias("__m"))
    joined = art.join(h, "id", "left").join(moved, "superseded_by", "left")
    hit = F.col("__w").isNotNull()
    return joined.withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.when(hit, F.col("__w")).otherwise(F.coalesce("__m", "superseded_by"))).select(*art.columns)


def merge_undone(art: DataFrame, merges: DataFrame) -> DataFrame:
    """Artifacts after merges (id) are undone: what they hid is active again, they are deprecated; ids of other artifacts change nothing."""
    real = merges.join(art.where("provenance = 'merged'").select("id"), "id", "left_semi")
    of = real.select(F.col("id").alias("superseded_by"), F.lit(True).alias("__free"))
    joined = _marked(art, real).join(of.distinct(), "superseded_by", "left")
    free = F.coalesce("__free", F.lit(False))
    status = F.when(F.col("__hit"), "deprecated").when(free, "active").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("superseded_by", F.when(~free, F.col("superseded_by"))).select(*art.columns)


def merges_reaped(art: DataFrame) -> DataFrame:
    """Merges in results whose embedding failed are deprecated."""
    lost = active() & (F.col("provenance") == "merged") & (F.col("embed_state") == "failed")
    return art.withColumn("status", F.when(lost, "deprecated").otherwise(F.col("status")))


def already_covered(needs: DataFrame, sources: DataFrame, art: DataFrame) -> DataFrame:
    """(need, covering): of needs (need, id) the first synthesized artifact whose roots are all that the needed artifacts come from."""
    roots = sources.select(F.col("child_id").alias("id"), "root_id")
    wanted = needs.join(roots, "id", "left").select(F.col("need").alias("id"), F.coalesce("root_id", "id").alias("member"))
    made = art.where(F.col("provenance") == "synthesized").select("id")
    theirs = roots.join(made, "id", "left_semi").select("id", F.col("root_id").alias("member"))
    # a need may have the number of an artifact: sides are told apart by their sign
    found = set_containment(theirs, wanted.select((-F.col("id") - 1).alias("id"), "member"))
    return found.select((-F.col("right_id") - 1).alias("need"), "left_id").groupBy("need").agg(F.min("left_id").alias("covering"))


def covered_passages(passages: DataFrame, written: DataFrame) -> DataFrame:
    """(passage_id, artifact_id): passages that a rewrite covers: over half of their lines, and one of its lines is in them word for word.

    passages: (passage_id, doc_id, start_line, end_line, text); written: (artifact_id, doc_id, start_line, end_line, ordinal, text).
    """
    from loamwork.operators.guards import traceable

    over = best_overlap(passages, written)
    texts = over.join(passages.select("passage_id", F.col("text").alias("window")), "passage_id").join(written.select("artifact_id", "text"), "artifact_id")
    return traceable(texts, ["passage_id", "artifact_id"])


def carried_activation(covered: DataFrame, activation: DataFrame, at: int, half_life_days: float = 14) -> DataFrame:
    """(id, activation): what artifacts that cover passages take over: the largest of theirs and their own, decayed to ``at``; 1 stands for an own one that is missing."""
    value = decayed(F.col("value"), F.col("since"), at, half_life_days)
    known = activation.select("id", value.alias("v"))
    lost = covered.join(known.withColumnRenamed("id", "passage_id"), "passage_id").groupBy(F.col("artifact_id").alias("id")).agg(F.max("v").alias("lost"))
    return lost.join(known, "id", "left").select("id", F.round(F.greatest("lost", F.coalesce("v", F.lit(1.0))), DIGITS).alias("activation"))


# Logs -----------------------------------------------------------------------------------------------------------


def events_with_candidates(events: DataFrame, candidates: DataFrame, start: int, end: int) -> DataFrame:
    """Recorded searches from ``start`` up to ``end`` with what they showed, in order of rank, and the artifact a hit confirmed."""
    shown = candidates.where("shown").groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("shown_ids"))
    some = events.where((F.col("at") >= start) & (F.col("at") < end) & (F.coalesce("door", F.lit("")) != "judge"))
    return some.join(shown, "event_id", "left").withColumn("confirmed", F.when(F.col("verdict") == "hit", F.col("expected")))


def asks_toggled(asks: DataFrame, citations: DataFrame, toggles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asks and citations after toggles (event_id, n) of what an answer was carried by; a first toggle also judges the answer right."""
    t = toggles.groupBy("event_id", "n").agg((F.count(F.lit(1)) % 2).alias("__odd"))
    cited = citations.join(t, ["event_id", "n"], "left").withColumn("carried", F.when(F.col("__odd") == 1, ~F.col("carried")).otherwise(F.col("carried"))).select(*citations.columns)
    return set_where(asks, toggles.select("event_id"), "event_id", verdict=F.coalesce("verdict", F.lit("right"))), cited


def dwell(interactions: DataFrame, most: int = 600) -> DataFrame:
    """Interactions with no dwell longer than ``most`` seconds."""
    return interactions.withColumn("seconds", F.when(F.col("kind") == "dwell", F.least("seconds", F.lit(most))).otherwise(F.col("seconds")))


def open_to_search(opens: DataFrame, searches: DataFrame, shown: DataFrame, within: int = 900) -> DataFrame:
    """(id, anchor): the time of the last search of an open's scope in the ``within`` seconds before it that showed its artifact; its own time if there is none.

    opens: (id, artifact_id, scope, at); searches: (event_id, scope, at); shown: (event_id, artifact_id). Scope and
    artifact are the keys and times meet in buckets, so no pair is formed that lies further apart.
    """
    bucket = lambda at: F.floor(at / within)
    s = searches.join(shown, "event_id").select(F.col("scope").alias("s"), F.col("artifact_id").alias("a"), F.col("at").alias("t"), F.explode(F.array(bucket(F.col("at")), bucket(F.col("at")) + 1)).alias("b"))
    o = opens.withColumn("__b", bucket(F.col("at")))
    met = o.join(s, F.coalesce(o.scope.cast("string"), F.lit("")).eqNullSafe(F.coalesce(s.s.cast("string"), F.lit(""))) & (o.artifact_id == s.a) & (o["__b"] == s.b) & F.col("at").between(F.col("t"), F.col("t") + within))
    last = met.groupBy("id").agg(F.max("t").alias("anchor"))
    return opens.join(last, "id", "left").select("id", F.coalesce("anchor", "at").alias("anchor"))


def gap_texts(coverage: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Coverage rows (kind, gap_id, ...) with the text of the gap; rows whose source is gone are left out. sources: kind to (id, text)."""
    every = None
    for kind, df in sorted(sources.items()):
        part = df.select(F.lit(kind).alias("kind"), F.col("id").alias("gap_id"), "text")
        every = part if every is None else every.unionByName(part)
    return coverage.join(every, ["kind", "gap_id"])


def covered_upsert(coverage: DataFrame, new: DataFrame) -> DataFrame:
    """Coverage after new rows; of one gap the newest row stays, of equal times the larger artifact."""
    both = coverage.unionByName(new.select(*coverage.columns))
    w = Window.partitionBy("kind", "gap_id").orderBy(F.desc("covered_at"), F.desc("artifact_id"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def cluster_key(members: Column) -> Column:
    return set_id(members)


# Links, pairs, jobs -----------------------------------------------------------------------------------------------


def link_counts(links: DataFrame, states: tuple[str, ...] = ("learning", "related", "dismissed")) -> DataFrame:
    """One row: links by state; a missing state is learning."""
    state = F.coalesce("state", F.lit("learning"))
    return links.agg(F.count(F.lit(1)).alias("links"), *[F.count_if(state == s).alias(s) for s in states])


def links_touching(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, ...): the links of each id, whichever end it is."""
    rest = [c for c in links.columns if c not in ("a_id", "b_id")]
    both = links.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), *rest).unionByName(links.select(F.col("b_id").alias("id"), F.col("a_id").alias("other"), *rest))
    return both.join(ids.select("id"), "id", "left_semi")


def link_states(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Links after changes (a_id, b_id, state), in either order of ends; a dismissed link stays so."""
    c = changes.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), F.col("state").alias("__s"))
    joined = links.join(c, ["a_id", "b_id"], "left")
    return joined.withColumn("state", F.when(F.col("state") == "dismissed", "dismissed").otherwise(F.coalesce("__s", "state"))).select(*links.columns)


def progress(rows: DataFrame, by: str, column: str, states: tuple[str, ...]) -> DataFrame:
    """(by, total, a column for each state)."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == s).alias(s) for s in states])


def judge_queue(pairs: DataFrame, art: DataFrame, jobs: DataFrame, budget: int, window: int = 200) -> DataFrame:
    """(id, action): what a tick does with the pending pairs, the first ``window`` by attempts, score and age: pairs with an end out of results are dismissed, up to ``budget`` others without a job are armed."""
    order = [F.asc("attempts"), F.desc("score"), F.desc("created_at"), F.asc("id")]
    first = pairs.where("state = 'pending'").orderBy(*order).limit(window)
    live = art.select("id", active().alias("live"))
    side = lambda p: live.select(F.col("id").alias(f"{p}_id"), F.col("live").alias(f"{p}_live"))
    both = first.join(side("a"), "a_id").join(side("b"), "b_id")
    armed = jobs.where("stage = 'dedupe' and state in ('pending', 'running')").select(F.col("target_id").alias("id"), F.lit(True).alias("__armed"))
    seen = both.join(armed, "id", "left").withColumn("__dead", ~(F.col("a_live") & F.col("b_live")))
    free = ~F.col("__dead") & F.col("__armed").isNull()
    turn = F.sum(F.when(free, 1).otherwise(0)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = seen.withColumn("__turn", F.coalesce(turn, F.lit(0)))
    return placed.where((F.col("__turn") < budget) & (F.col("__dead") | free)).select("id", F.when(F.col("__dead"), "dismiss").otherwise("arm").alias("action"))


def jobs_armed(jobs: DataFrame, new: DataFrame, at: int, closed_only: bool = False) -> DataFrame:
    """Jobs after new ones (stage, target_id, seq, class): a known one begins afresh, with ``closed_only`` if it is done or failed."""
    key = ["stage", "target_id"]
    n = new.select(*key, F.col("seq").alias("__seq"), F.col("class").alias("__class"), F.lit(True).alias("__new"))
    joined = jobs.withColumn("__old", F.lit(True)).join(n, key, "full")
    afresh = F.coalesce("__new", F.lit(False)) & (F.col("__old").isNull() | (F.col("state").isin("done", "failed") if closed_only else F.lit(True)))
    fresh = {"state": F.lit("pending"), "attempts": F.lit(0), "run_after": F.lit(0), "created_at": F.lit(at), "seq": F.col("__seq"), "class": F.col("__class")}
    kinds = dict(jobs.dtypes)
    return joined.select(*[F.when(afresh, fresh[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in jobs.columns])


def jobs_reclaimed(jobs: DataFrame, now: int, stuck: int = 600) -> DataFrame:
    """Running jobs claimed longer ago than ``stuck`` seconds are pending again."""
    lost = (F.col("state") == "running") & (F.col("claimed_at") < now - stuck)
    return jobs.withColumn("state", F.when(lost, "pending").otherwise(F.col("state"))).withColumn("claimed_at", F.when(~F.coalesce(lost, F.lit(False)), F.col("claimed_at")))


def unfinished(corpora: DataFrame, jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """(corpus_id, missing): captures that nothing goes on with: queued ones without a job, and those whose windows none is going to read."""
    live = jobs.where("state in ('pending', 'running')").select(F.col("target_id").alias("corpus_id")).distinct()
    idle = corpora.where("status in ('queued', 'processing')").join(live, "corpus_id", "left_anti")
    waiting = segments.where("state = 'pending'").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"))
    return idle.join(waiting, "corpus_id", "left").select("corpus_id", F.when(F.col("n") > 0, "window").otherwise("segment").alias("missing"))


def segments_replaced(segments: DataFrame, new: DataFrame, art: DataFrame) -> DataFrame:
    """Windows after new cuts of corpora; a corpus with a finished window, or with artifacts of its windows, keeps its own."""
    done = segments.where("state = 'done'").select("corpus_id")
    owned = art.where("segment_idx is not null").select("corpus_id")
    free = new.join(done.unionByName(owned).distinct(), "corpus_id", "left_anti")
    return segments.join(free.select("corpus_id").distinct(), "corpus_id", "left_anti").unionByName(free.select(*segments.columns))


# What a page shows ------------------------------------------------------------------------------------------------


def diagnosis(rank: Column, verdict: Column, far: int = 10) -> Column:
    """What a judgement says about the search, by the right answer's rank from 0 (null: not found): unknown, dropped, missed, misplaced, low or top."""
    place = F.when(rank.isNull(), "missed").when(rank == 0, "top").when(rank < far, "low").otherwise("misplaced")
    return F.when(verdict == "hit", place).otherwise(F.element_at(F.create_map(F.lit("gap"), F.lit("unknown"), F.lit("discard"), F.lit("dropped")), verdict))


def offer_title(title: Column, text: Column, most: int = 70) -> Column:
    """The title, or the first line, cut with an ellipsis."""
    line = F.trim(F.get(F.split(F.coalesce(text, F.lit("")), "\r?\n"), F.lit(0)))
    cut = F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(cut)


def corpus_slice(corpora: DataFrame, context: int = 3, preview: int = 40) -> DataFrame:
    """(id, number, text, in_span): the lines of a span (start_line, end_line) and ``context`` around it; without a span the first ``preview``. corpora: (id, text, start_line, end_line)."""
    lines = corpora.select("id", "start_line", "end_line", F.posexplode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r?\n\z", ""), "\r?\n")).alias("p", "text")).withColumn("number", F.col("p") + 1)
    inside = F.col("number").between(F.col("start_line") - context, F.col("end_line") + context)
    shown = lines.where(F.when(F.col("start_line").isNull(), F.col("number") <= preview).otherwise(inside))
    return shown.select("id", F.col("number").cast("long").alias("number"), "text", F.coalesce(F.col("number").between(F.col("start_line"), F.col("end_line")), F.lit(False)).alias("in_span"))


def encoder_version(layout: tuple[tuple[str, int, float], ...]) -> str:
    """MD5 of a vector's layout: names, sizes and weights of its blocks in order."""
    import hashlib

    return hashlib.md5("|".join(f"{name}:{size}:{weight:g}" for name, size, weight in layout).encode()).hexdigest()
