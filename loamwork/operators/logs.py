"""What search and interaction logs teach: sessions, links, activation, pursuits, retention.

Times are epoch seconds. A null scope is a scope of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.text import decayed
from loamwork.operators import metrics
from loamwork.operators.dealing import beside, bucket, parts_of
from loamwork.operators.graph import connected_components
from loamwork.operators.joins import asof_backward
from loamwork.operators.retrieval import cosine_links
from loamwork.storage import materialise

DIGITS = 6
CANDIDATES = 20
#: Things of one event that are paired in one row; what an event shows beyond goes in blocks of so many.
WIDE = 256


def _runs(events: DataFrame, by: list[str], starts: Callable[[Column], Column], held: list[str], days: int) -> DataFrame:
    """Adds ``__run``: how many runs have begun in its group up to an event. ``starts``: whether one begins, from the event and the one before it (at, id, ``held``; null for none).

    A group is walked in stretches of ``days``, so one that holds a great share of all events is many tasks'
    work; a stretch knows the event before its first, and how many runs began earlier.
    """
    dealt = events.withColumn("__b", F.floor(F.col("at") / (days * 86400)))
    own, order = Window.partitionBy(*by, "__b").orderBy("at", "id"), Window.partitionBy(*[f"__{c}" for c in by]).orderBy("__eb")
    row = F.struct("at", "id", *held)
    keys = [*[F.col(c).alias(f"__{c}") for c in by], F.col("__b").alias("__eb")]
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]) & (F.col("__b") == F.col("__eb"))
    gone = [*[f"__{c}" for c in by], "__eb"]
    ends = dealt.groupBy(*keys).agg(F.max_by(row, F.struct("at", "id")).alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last").over(order)).drop("__last")
    met = dealt.join(ends, same).drop(*gone).withColumn("__prev", F.coalesce(F.lag(row).over(own), F.col("__before")))
    marked = met.withColumn("__new", F.when(starts(F.col("__prev")), 1).otherwise(0)).withColumn("__run", F.sum("__new").over(own)).drop("__before", "__prev")
    begun = marked.groupBy(*keys).agg(F.sum("__new").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = begun.withColumn("__earlier", earlier).drop("__n")
    return marked.join(begun, same).withColumn("__run", F.col("__run") + F.col("__earlier")).select(*events.columns, "__run")


def sessions(events: DataFrame, idle: int, by: str = "scope", days: int = 7) -> DataFrame:
    """Numbers each scope's sittings from 0: a pause of more than ``idle`` seconds starts a new one. Needs at and id."""
    return _runs(events, [by], lambda before: F.col("at") - before["at"] > idle, [], days).withColumnRenamed("__run", "session")


def coalesce_queries(events: DataFrame, gap: int = 15, days: int = 7) -> DataFrame:
    """The events that are left when keystrokes fold: a query that extends its predecessor, or is a prefix of it, within ``gap`` seconds of it.

    Needs id, door, scope, at, query, pool. In batch form, runs of such neighbours fold to the longest
    query, the latest of equals; an event that would replace a filled pool by an empty one starts a run.
    """

    def starts(before: Column) -> Column:
        related = F.startswith(F.col("query"), before["query"]) | F.startswith(before["query"], F.col("query"))
        empties = (F.col("pool") == 0) & (before["pool"] > 0)
        return ~F.coalesce((F.lit(gap) > 0) & (F.col("at") - before["at"] <= gap) & related & ~empties, F.lit(False))

    runs = _runs(events, ["door", "scope"], starts, ["query", "pool"], days)
    last = Window.partitionBy("door", "scope", "__run").orderBy(F.desc(F.char_length("query")), F.desc("at"), F.desc("id"))
    return runs.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__run", "__n")


def _shown_sets(candidates: DataFrame, by: list[str], most: int, apart: list[Column] | None = None, *more: Column) -> DataFrame:
    """(by, ids, ...): the different things that each event showed, at least two. ``apart``: rows that are counted by themselves; ``more``: what else is gathered."""
    w = Window.partitionBy(*by, *(apart or [])).orderBy("rank", "id")
    first = F.when(F.col("__n") <= most, F.col("id"))
    return candidates.withColumn("__n", F.row_number().over(w)).groupBy(*by).agg(F.array_sort(F.collect_set(first)).alias("ids"), *more).where(F.size("ids") > 1)


def _paired(sets: DataFrame, *rest: str) -> DataFrame:
    """(rest, a_id, b_id) of the pairs within each row's ids."""
    n = F.size("ids")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.slice("ids", i + 1, n), lambda b: F.struct(F.element_at("ids", i).alias("a_id"), b.alias("b_id")))))
    return sets.select(*rest, F.explode(pairs).alias("p")).select(*rest, "p.a_id", "p.b_id")


def shown_pairs(candidates: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(event_id, a_id, b_id) of unordered pairs that one event showed; an event shows ``most`` at most, by rank.

    The bound is part of what the log is: a search stores the first ``most`` candidates that it showed, so a larger list
    is of another making, and its further rows were never on a screen.
    """
    return _paired(_shown_sets(candidates, ["event_id"], most), "event_id")


def _counted_pairs(candidates: DataFrame, parts: int) -> DataFrame:
    """(a_id, b_id, n) of all pairs that events showed, added up in part.

    The things of an event are cut into blocks of ``WIDE``, in the order of their ids. A block's own pairs are made where it lies, those of two blocks in
    tasks dealt by both, so an event of any width is never one row or one task's pairs.
    """
    event = Window.partitionBy("__deal", "event_id")
    dealt = candidates.where("event_id is not null and id is not null").select("event_id", "id", bucket(parts, "event_id").alias("__deal")).repartition(parts, "__deal")
    placed = dealt.withColumn("__block", F.floor((F.dense_rank().over(event.orderBy("id")) - 1) / WIDE).cast("int"))
    by = ["__deal", "event_id", "__block"]
    ids = F.array_sort(F.collect_set("id")).alias("ids")
    own = _paired(placed.groupBy(*by).agg(ids).where(F.size("ids") > 1), "__deal").groupBy("__deal", "a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    wide = placed.withColumn("__top", F.max("__block").over(event)).where("__top > 0").groupBy(*by, "__top").agg(ids)
    cells = wide.select("event_id", "__block", "ids", F.explode(F.sequence(F.lit(0), "__top")).alias("__other")).where("__block <> __other")
    ends = [F.least("__block", "__other").alias("__i"), F.greatest("__block", "__other").alias("__j")]
    cells = cells.select("event_id", *ends, F.struct("__block", "ids").alias("x")).repartition(4 * max(parts, candidates.sparkSession.sparkContext.defaultParallelism), "event_id", "__i", "__j")
    met = cells.groupBy("event_id", "__i", "__j").agg(F.array_sort(F.collect_list("x")).alias("x"))
    # ids rise from block to block
    across = met.select(F.explode(F.element_at("x", 1)["ids"]).alias("a_id"), F.element_at("x", 2)["ids"].alias("b")).select("a_id", F.explode("b").alias("b_id"))
    return own.select("a_id", "b_id", "n").unionByName(across.groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n")))


def hebbian_links(candidates: DataFrame, links: DataFrame | None = None, at: int = 0, half_life_days: float = 30, step: float = 1.0, most: int | None = None) -> DataFrame:
    """(a_id, b_id, weight, n_events): each pair shown together gains ``step`` per event on what is left of its old weight. All that an event showed counts; with ``most``, that many by rank, as in ``shown_pairs``.

    Events and pairs are dealt to as many tasks as there is work for; what an event's task has of a pair is added up before it goes on.
    """
    parts = parts_of(candidates.sparkSession, candidates.count())
    if most is None:
        pairs = _counted_pairs(candidates, parts)
    else:
        dealt = candidates.withColumn("__deal", bucket(parts, "event_id")).repartition(parts, "__deal")
        pairs = _paired(_shown_sets(dealt, ["__deal", "event_id"], most), "__deal").groupBy("__deal", "a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    gained = pairs.repartition(parts, "a_id", "b_id").groupBy("a_id", "b_id").agg(F.sum("n").alias("n_events")).withColumn("gain", F.col("n_events") * step)
    if links is None:
        return gained.select("a_id", "b_id", F.round("gain", DIGITS).alias("weight"), "n_events")
    old = links.select("a_id", "b_id", decayed(F.col("weight"), F.col("bumped_at"), at, half_life_days).alias("old"))
    both = gained.join(old, ["a_id", "b_id"], "full")
    weight = F.coalesce("gain", F.lit(0.0)) + F.coalesce("old", F.lit(0.0))
    return both.select("a_id", "b_id", F.round(weight, DIGITS).alias("weight"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def link_cues(candidates: DataFrame, events: DataFrame, most: int = 3) -> DataFrame:
    """(a_id, b_id, queries, cues): how many different queries showed a pair, and the ``most`` that did so most often, the first in the alphabet of equals. events: (event_id, query).

    An event's query lies with what it showed before pairs are made, and pairs are dealt as those of ``hebbian_links``.
    """
    parts = parts_of(candidates.sparkSession, candidates.count())
    said = F.struct("query")
    shown = candidates.select("event_id", "id", "rank").unionByName(events.select("event_id", said.alias("said")), allowMissingColumns=True)
    dealt = shown.withColumn("__deal", bucket(parts, "event_id")).repartition(parts, "__deal")
    sets = _shown_sets(dealt.where("event_id is not null"), ["__deal", "event_id"], CANDIDATES, [F.col("said").isNull()], F.collect_list("said").alias("said"))
    asked = _paired(sets.select("__deal", "ids", F.explode("said").alias("s")).select("__deal", "ids", "s.query"), "__deal", "query")
    own = asked.groupBy("__deal", "a_id", "b_id", "query").agg(F.count(F.lit(1)).alias("n"))
    cued = own.repartition(parts, "a_id", "b_id").groupBy("a_id", "b_id", "query").agg(F.sum("n").alias("n"))
    return _top_cues(cued, most)


def _top_cues(cued: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("a_id", "b_id").orderBy(F.desc("n"), "query"))
    first = F.when(F.col("place") <= most, F.struct("place", "query", "n"))
    cues = F.transform(F.array_sort(F.collect_list(first)), lambda x: F.struct(x["query"].alias("query"), x["n"].alias("n")))
    return cued.withColumn("place", place).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("queries"), cues.alias("cues"))


def carried_cues(cues: DataFrame, moved: DataFrame, most: int = 3, parts: int | None = None) -> DataFrame:
    """Cues (a_id, b_id, cues) after artifacts moved (old_id, new_id): of links that fall together, each cue with its larger count, the ``most`` first. ``parts``: in how many tasks, the session's number if not said."""
    a, b = moved.select(F.col("old_id").alias("a_id"), F.col("new_id").alias("na")), moved.select(F.col("old_id").alias("b_id"), F.col("new_id").alias("nb"))
    each = beside(beside(cues.select("a_id", "b_id", F.inline("cues")), a, "a_id", parts), b, "b_id", parts)
    x, y = F.coalesce("na", "a_id"), F.coalesce("nb", "b_id")
    ends = each.select(F.least(x, y).alias("a_id"), F.greatest(x, y).alias("b_id"), "query", "n").where("a_id <> b_id")
    ends = ends.repartition(parts, "a_id", "b_id") if parts else ends
    return _top_cues(ends.groupBy("a_id", "b_id", "query").agg(F.max("n").alias("n")), most).select("a_id", "b_id", "cues")


def verdict_bumps(verdicts: DataFrame, candidates: DataFrame, link: float = 2.0, activation: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Of judged events (event_id, expected, at): links (a_id, b_id, gain) to the others shown if it was shown itself, and activation (id, at, gain) always."""
    shown = candidates.select("event_id", "id")
    seen = verdicts.join(shown, (verdicts.event_id == shown.event_id) & (verdicts.expected == shown.id), "left_semi")
    others = seen.join(shown, "event_id").where("expected <> id")
    links = others.groupBy(F.least("expected", "id").alias("a_id"), F.greatest("expected", "id").alias("b_id")).agg((F.count(F.lit(1)) * link).alias("gain"))
    return links, verdicts.select(F.col("expected").alias("id"), "at", F.lit(activation).alias("gain"))


def activation(bumps: DataFrame, at: int, half_life_days: float = 14) -> DataFrame:
    """(id, activation): every gain decayed to ``at`` and summed, which equals decaying step by step. bumps: (id, at, gain)."""
    return bumps.groupBy("id").agg(F.round(F.sum(decayed(F.col("gain"), F.col("at"), at, half_life_days)), DIGITS).alias("activation"))


def prune_links(links: DataFrame, at: int, least: float = 0.5, half_life_days: float = 30) -> DataFrame:
    """Learning links that have decayed below ``least`` go; judged ones stay."""
    low = decayed(F.col("weight"), F.col("bumped_at"), at, half_life_days) < least
    return links.where(~((F.coalesce("state", F.lit("learning")) == "learning") & low))


def links_to_judge(links: DataFrame, origins: DataFrame, at: int, least: float = 4.0, queries: int = 3, half_life_days: float = 30) -> DataFrame:
    """Learning links strong and varied enough whose live ends share no origin. origins: (id, corpora)."""
    strong = links.where((F.coalesce("state", F.lit("learning")) == "learning") & (F.col("queries") >= queries) & (decayed(F.col("weight"), F.col("bumped_at"), at, half_life_days) >= least))
    a, b = origins.select(F.col("id").alias("a_id"), F.col("corpora").alias("ca")), origins.select(F.col("id").alias("b_id"), F.col("corpora").alias("cb"))
    return strong.join(a, "a_id").join(b, "b_id").where(F.size(F.array_intersect("ca", "cb")) == 0).drop("ca", "cb")


def reopened(links: DataFrame, revisions: DataFrame, parts: int | None = None) -> DataFrame:
    """Judged links whose ends changed since: state back to learning. revisions: (id, rev). ``parts``: in how many tasks, the session's number if not said."""
    a, b = revisions.select(F.col("id").alias("a_id"), F.col("rev").alias("ra")), revisions.select(F.col("id").alias("b_id"), F.col("rev").alias("rb"))
    joined = beside(beside(links, a, "a_id", parts), b, "b_id", parts)
    changed = ~F.col("judged_rev_a").eqNullSafe(F.col("ra")) | ~F.col("judged_rev_b").eqNullSafe(F.col("rb"))
    return joined.withColumn("state", F.when((F.col("state") != "learning") & (F.col("state") != "dismissed") & changed, "learning").otherwise(F.col("state"))).drop("ra", "rb")


def need_features(interactions: DataFrame, searches: DataFrame, weak_below: float = 0.35) -> DataFrame:
    """One row a need of what was done in it.

    searches: (need, event_id, at, is_ask, answered, abstained, confirmed); interactions: (need, event_id, id, artifact_id, kind, at, seconds, similarity, shown).
    Opened counts 1, pivoted 1.5, a return to an artifact after another 2 more, confirmed 3; offers made count nothing, dwell at most 0.5 an artifact and apart.
    """
    acts = interactions.where("kind <> 'recommended_shown'").join(searches.select("need", "event_id", "answered", "is_ask"), ["need", "event_id"]).where("not answered and not is_ask")
    done = acts.where("kind <> 'dwell'")
    w = Window.partitionBy("need").orderBy("at", "id")
    again = F.row_number().over(Window.partitionBy("need", "artifact_id").orderBy("at", "id")) > 1
    steps = done.withColumn("returned", again & (F.lag("artifact_id").over(w) != F.col("artifact_id")))
    worth = F.when(F.col("kind") == "pivoted", 1.5).otherwise(1.0) + F.when(F.col("returned"), 2.0).otherwise(0.0)
    strong = F.coalesce(F.col("shown") & (F.col("similarity").isNull() | (F.col("similarity") >= weak_below)), F.lit(False))
    by_act = steps.groupBy("need").agg(
        F.sum(worth).alias("acted"), F.sum(F.when(F.col("kind") == "pivoted", 1).otherwise(0)).alias("pivots"), F.sum(F.when(F.col("returned"), 1).otherwise(0)).alias("returns"), F.max(strong).alias("strong")
    )
    artifacts = steps.select("need", "artifact_id").union(searches.where("confirmed is not null").select("need", "confirmed")).groupBy("need").agg(F.count_distinct("artifact_id").alias("engaged"), F.min("artifact_id").alias("only"))
    opened = done.select("need", "event_id").distinct().withColumn("opened", F.lit(True))
    order = Window.partitionBy("need").orderBy("at", "event_id")
    turned = searches.join(opened, ["need", "event_id"], "left").withColumn("followed", F.lead("event_id").over(order).isNotNull())
    empty = ~F.col("is_ask") & F.col("opened").isNull() & F.col("confirmed").isNull() & ~F.col("answered")
    by_search = turned.groupBy("need").agg(
        F.count(F.lit(1)).alias("n_searches"),
        F.max("answered").alias("answered"),
        F.max("abstained").alias("abstained"),
        F.sum(F.when(F.col("confirmed").isNotNull(), 3.0).otherwise(0.0)).alias("confirmed_weight"),
        F.sum(F.when(empty & F.col("followed"), 1).otherwise(0)).alias("refined"),
        F.max(empty & ~F.col("followed")).alias("abandoned"),
    )
    out = by_search.join(by_act, "need", "left").join(artifacts, "need", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "need", "n_searches", "answered", "abstained", "refined", "abandoned",
        zero("engaged").alias("engaged"), "only", zero("pivots").alias("pivots"), zero("returns").alias("returns"),
        (F.coalesce("strong", F.lit(False)) | (F.col("confirmed_weight") > 0)).alias("strong_engaged"),
        F.round(F.coalesce("acted", F.lit(0.0)) + F.col("confirmed_weight"), DIGITS).alias("engagement"),
    )


def decide(min_sources: int = 2, min_engagement: float = 3.0) -> Column:
    """Satisfied, promote, unsatisfied or generate, from the columns of ``need_features``."""
    unmet = ~F.col("strong_engaged") | (F.col("refined") >= 2) | F.col("abandoned") | F.col("abstained")
    few = F.col("engaged") < min_sources
    return (
        F.when(F.col("answered"), "satisfied")
        .when(few & (F.col("engaged") == 1), "promote")
        .when(few, F.when(unmet, "unsatisfied").otherwise("satisfied"))
        .when((F.col("engagement") >= min_engagement) & (unmet | (F.col("pivots") + F.col("returns") > 0)), "generate")
        .when(unmet, "unsatisfied")
        .otherwise("satisfied")
    )


def pursuit_sweep(searches: DataFrame, asks: DataFrame, interactions: DataFrame, now: int, idle: int, after: int = 0, lookback: int = 86400) -> DataFrame:
    """One row a need of the log since ``after``, ``lookback`` at most, with its features and decision; none while events still come in.

    searches: (event_id, scope, at, query, vector, answered, confirmed); asks: (event_id, scope, at, query, vector, abstained), ids apart from
    those of searches; interactions: (id, artifact_id, scope, kind, at, seconds, similarity, shown). Events whose vectors hang together at
    the calibrated threshold are one topic, and a topic's sittings, apart by more than ``idle``, are needs. An interaction belongs to the last event of its scope up to ``idle`` seconds before.
    """
    since = max(after, now - lookback)
    no = F.lit(False)
    shape = ["event_id", "scope", "at", "query", "vector", "is_ask", "answered", "abstained", "confirmed"]
    one = searches.withColumn("is_ask", no).withColumn("abstained", no).select(*shape)
    two = asks.withColumn("is_ask", F.lit(True)).withColumn("answered", no).withColumn("confirmed", F.lit(None).cast(searches.schema["confirmed"].dataType)).select(*shape)
    recent = (F.col("at") > since) & (F.col("at") <= now)
    newest = one.select("at").unionByName(two.select("at")).unionByName(interactions.select("at")).where(recent).agg(F.max("at").alias("__newest"))
    quiet = F.broadcast(newest.where(F.col("__newest").isNull() | (now - F.col("__newest") >= idle)))
    events = materialise(one.unionByName(two).where(recent & (F.size("vector") > 0)).join(quiet).drop("__newest"), "pursuit-events")
    vectors = events.select(F.col("event_id").alias("id"), "vector")
    # one number
    line = metrics.link_threshold(vectors).first().threshold
    topics = connected_components(cosine_links(vectors, line))
    placed = events.join(topics, F.col("event_id") == F.col("node"), "left").withColumn("topic", F.coalesce("component", "event_id")).drop("node", "component")
    needs = sessions(placed.withColumnRenamed("event_id", "id"), idle, "topic").withColumnRenamed("id", "event_id")
    needs = needs.withColumn("need", F.concat_ws(":", F.col("topic").cast("string"), F.col("session").cast("string")))
    owners = asof_backward(interactions.where(recent).select("id", "at", "scope"), events.select(F.col("event_id").alias("id"), "at", "scope"), "scope", idle)
    owned = interactions.drop("at", "scope").join(owners.select("id", "at", F.col("right_id").alias("event_id")).where("event_id is not null"), "id").join(needs.select("event_id", "need"), "event_id")
    features = need_features(owned.select("need", "event_id", "id", "artifact_id", "kind", "at", "seconds", "similarity", "shown"), needs.select("need", "event_id", "at", "is_ask", "answered", "abstained", "confirmed"))
    opened = needs.groupBy("need").agg(F.min("at").alias("opened_at"), F.max("at").alias("last_at"))
    return features.withColumn("decision", decide()).join(opened, "need")


def sittings(events: DataFrame, keep: int = 20) -> DataFrame:
    """(scope, session, id, place): the ``keep`` things a sitting touched last, the newest first; a thing touched twice counts at its last time."""
    last = events.groupBy("scope", "session", "artifact_id").agg(F.max(F.struct("at", "id")).alias("t"))
    w = Window.partitionBy("scope", "session").orderBy(F.desc("t"))
    return last.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < keep).select("scope", "session", "artifact_id", "place")


def retained(events: DataFrame, at: int, days: dict[str, int], default: int = 400) -> DataFrame:
    """Events younger than their kind's days; 0 keeps for ever."""
    limit = F.lit(default)
    for kind, d in sorted(days.items()):
        limit = F.when(F.col("kind") == kind, F.lit(d)).otherwise(limit)
    return events.where((limit == 0) | (F.col("at") >= at - limit * 86400))


def before_watermark(events: DataFrame, now: int, coalesce: int = 15) -> DataFrame:
    """Events that can no longer fold into a later one."""
    return events.where(F.col("at") < now - coalesce)


def complete_seconds(page: DataFrame, limit: int) -> DataFrame:
    """A full page without its last second, which the next page may complete; a page of one second stays whole."""
    top = page.agg(F.count(F.lit(1)).alias("__n"), F.max("at").alias("__max"), F.min("at").alias("__min"))
    return page.join(F.broadcast(top)).where((F.col("__n") < limit) | (F.col("at") < F.col("__max")) | (F.col("__min") == F.col("__max"))).drop("__n", "__max", "__min")


def to_promote(art: DataFrame, at: int, least: float = 4.0, half_life_days: float = 14) -> DataFrame:
    """(corpus_id, segment_idx) whose live passages are active enough."""
    live = art.where((F.coalesce("status", F.lit("active")) == "active") & F.col("superseded_by").isNull() & (F.col("provenance") == "passage"))
    return live.where(decayed(F.col("activation"), F.col("activated_at"), at, half_life_days) >= least).select("corpus_id", "segment_idx").distinct()


def forgotten(points: DataFrame, created_before: int, unseen_since: int) -> DataFrame:
    """Active points made before one time and not seen since another."""
    return points.where((F.coalesce("status", F.lit("active")) == "active") & (F.col("created_at") < created_before) & (F.col("last_seen_at").isNull() | (F.col("last_seen_at") < unseen_since)))


def stale(points: DataFrame, before: int, most_hits: int = 0) -> DataFrame:
    """Active points verified before a time and hit no more often than that; rows never verified are left out."""
    return points.where((F.coalesce("status", F.lit("active")) == "active") & (F.col("verified_at") < before) & (F.coalesce("hit_count", F.lit(0)) <= most_hits))
