"""Listings, counts, pick orders and small updates over the tables of a base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.graph import connected_components
from loamwork.operators.metrics import terms_label
from loamwork.operators.retrieval import cosine_links, cosine_scan, ranked


def page_after(rows: DataFrame, at: object, last_id: object, size: int) -> DataFrame:
    """The ``size`` rows after a key (at, id), newest first; None starts at the top. A page is the feature, so the limit stays."""
    if at is not None:
        rows = rows.where((F.col("at") < F.lit(at)) | ((F.col("at") == F.lit(at)) & (F.col("id") < F.lit(last_id))))
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(size)


def pick(rows: DataFrame, order: list[Column], n: int, due: Column | None = None) -> DataFrame:
    """The next ``n`` rows to work on: due ones, in the given order."""
    return (rows.where(due) if due is not None else rows).orderBy(*order).limit(n)


def newest_per_group(rows: DataFrame, group: str, n: int) -> DataFrame:
    """The newest ``n`` rows (at, id) of each group; older ones are trimmed."""
    w = Window.partitionBy(group).orderBy(F.desc("at"), F.desc("id"))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def counts_by(rows: DataFrame, key: str, states: list[str] | None = None) -> DataFrame:
    """(value, n); with ``states`` one row with a column for each."""
    if states is None:
        return rows.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(*[F.count_if(F.col(key) == s).alias(s) for s in states])


def ask_stats(asks: DataFrame) -> DataFrame:
    """One row: asked, abstained, and verdicts by kind. asks: (abstained, verdict)."""
    v = F.col("verdict")
    return asks.agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(F.col("abstained")).alias("abstained"), F.count_if(v.isNull()).alias("pending"),
        F.count_if(v == "right").alias("right"), F.count_if(v == "wrong").alias("wrong"), F.count_if(v == "nothing_here").alias("nothing_here"),
    )


def newest_event(*logs: DataFrame) -> DataFrame:
    """One row (at): the latest time of several logs; empty logs are passed over."""
    tops = [log.agg(F.max("at").alias("at")) for log in logs]
    return reduce(DataFrame.unionByName, tops).agg(F.max("at").alias("at"))


def bands(lines: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, band, first, last, ids): runs of lines that the same spans cover; blank lines go with the line before.

    lines: (doc_id, line, blank); spans: (doc_id, id, start_line, end_line). Spans are dealt to blocks of ``width`` lines.
    """
    spread = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    on = (F.col("l.doc_id") == F.col("s.doc_id")) & (F.col("l.b") == F.col("s.b")) & F.col("l.line").between(F.col("s.start_line"), F.col("s.end_line"))
    met = lines.withColumn("b", F.floor(F.col("line") / width)).alias("l").join(spread.alias("s"), on, "left")
    held = met.groupBy("l.doc_id", "l.line", "l.blank").agg(F.array_join(F.array_sort(F.collect_set("s.id")), ",").alias("own"))
    w = Window.partitionBy("doc_id").orderBy("line")
    ids = F.coalesce(F.last(F.when(~F.col("blank"), F.col("own")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("own"))
    named = held.withColumn("ids", ids)
    turned = named.withColumn("turn", F.when(F.col("ids") == F.lag("ids").over(w), 0).otherwise(1)).withColumn("band", F.sum("turn").over(w) - 1)
    return turned.groupBy("doc_id", "band", "ids").agg(F.min("line").alias("first"), F.max("line").alias("last")).select("doc_id", "band", "first", "last", "ids")


def open_component(pairs: DataFrame, seed: DataFrame) -> DataFrame:
    """(a_id, b_id): the pairs that pending pairs connect to the seeds (id)."""
    of = connected_components(pairs.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    mine = of.join(seed.select(F.col("id").alias("node")), "node", "left_semi").select("component").distinct()
    nodes = of.join(mine, "component", "left_semi").select(F.col("node").alias("a_id"))
    return pairs.join(nodes, "a_id", "left_semi")


def gap_clusters(gaps: DataFrame, threshold: float, smallest: int = 2) -> DataFrame:
    """(key, label, n, members): gaps (id, text, vector) linked at a cosine; groups under ``smallest`` are left out.

    Single linkage by all pairs of tiles, of which only what hangs together goes on.
    """
    of = connected_components(cosine_links(gaps.select("id", "vector"), threshold))
    members = of.join(gaps.select(F.col("id").alias("node"), "text"), "node")
    labels = terms_label(members.select("component", "text"), "component")
    grouped = members.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= smallest)
    return grouped.join(labels, "component", "left").select(F.sha2(F.array_join(F.col("members").cast("array<string>"), ","), 256).alias("key"), F.coalesce("label", F.lit("")).alias("label"), "n", "members")


def covered_gaps(gaps: DataFrame, art: DataFrame, weak_below: float = 0.35) -> DataFrame:
    """(gap_id, id, score): the best new artifact of each gap, where it is not weak."""
    best = ranked(cosine_scan(art.select("id", "vector"), gaps.select(F.col("id").alias("q_id"), "vector"), 1, weak_below), F.desc("score"), F.asc("id"), limit=1)
    return best.select(F.col("q_id").alias("gap_id"), "id", "score")


def unsupported(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose pointer names nothing in the other table; null pointers name nothing to miss."""
    return rows.where(F.col(key).isNotNull()).join(other.select(F.col("id").alias(key)), key, "left_anti")


def stranded_merges(art: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source_count, n): merges that have fewer sources left than they were made from. sources: (child_id, root_id)."""
    have = sources.groupBy(F.col("child_id").alias("id")).agg(F.count_distinct("root_id").alias("n"))
    merged = art.where(F.col("provenance").isin("merged", "synthesized"))
    return merged.join(have, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < F.col("source_count")).select("id", "source_count", "n")


def with_verdicts(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Search events after judging: verdicts (event_id, verdict, expected); an undo clears both, a skip only counts."""
    v = verdicts.select("event_id", F.col("verdict").alias("__v"), F.col("expected").alias("__e"))
    joined = events.join(v, "event_id", "left")
    judged, undone, skipped = F.col("__v").isin("hit", "gap", "discard"), F.col("__v") == "undo", F.coalesce(F.col("__v") == "skip", F.lit(False))
    return (
        joined.withColumn("verdict", F.when(judged, F.col("__v")).when(~F.coalesce(undone, F.lit(False)), F.col("verdict")))
        .withColumn("expected", F.when(judged, F.when(F.col("__v") == "hit", F.col("__e"))).when(~F.coalesce(undone, F.lit(False)), F.col("expected")))
        .withColumn("skips", F.col("skips") + skipped.cast("int"))
        .drop("__v", "__e")
    )


def edited(art: DataFrame, edits: DataFrame) -> DataFrame:
    """Artifacts after edits (id, text, title), null leaving a field; a new text makes the embedding pending under a new revision."""
    e = edits.select("id", F.col("text").alias("__text"), F.col("title").alias("__title"))
    joined = art.join(e, "id", "left").withColumn("__new", F.coalesce(F.col("__text") != F.col("text"), F.lit(False)))
    return (
        joined.withColumn("text", F.coalesce("__text", "text"))
        .withColumn("title", F.coalesce("__title", "title"))
        .withColumn("embed_rev", F.col("embed_rev") + F.col("__new").cast("int"))
        .withColumn("embed_state", F.when(F.col("__new"), "pending").otherwise(F.col("embed_state")))
        .select(*art.columns)
    )


def embedded(art: DataFrame, done: DataFrame) -> DataFrame:
    """Marks embeddings (id, rev) as done where the revision is still the same."""
    d = done.select("id", F.col("rev").alias("__rev"))
    joined = art.join(d, "id", "left")
    return joined.withColumn("embed_state", F.when(F.col("__rev") == F.col("embed_rev"), "done").otherwise(F.col("embed_state"))).drop("__rev")


def to_resynthesise(art: DataFrame, shown: DataFrame, least: int) -> DataFrame:
    """Artifacts shown ``least`` times or more and never confirmed. shown: (id, n_shown, n_confirmed)."""
    return art.join(shown.where((F.col("n_shown") >= least) & (F.coalesce("n_confirmed", F.lit(0)) == 0)), "id", "left_semi")


def aged(jobs: DataFrame, now: int, after: int) -> DataFrame:
    """Jobs that have waited longer move up a class, class 0 being the first."""
    return jobs.withColumn("class", F.when(F.col("queued_at") < now - after, F.greatest(F.col("class") - 1, F.lit(0))).otherwise(F.col("class")))


def excerpt(title: Column, text: Column, number: Column) -> Column:
    """A numbered source as an answer's prompt shows it."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(F.concat(title, F.lit("\n")), F.lit("")), text)


def judging_order(candidates: DataFrame) -> DataFrame:
    """(event_id, id, place): each event's candidates in a stable order that gives nothing away."""
    w = Window.partitionBy("event_id").orderBy(F.md5(F.concat_ws("|", F.col("event_id").cast("string"), F.col("id").cast("string"))), "id")
    return candidates.select("event_id", "id", (F.row_number().over(w) - 1).alias("place"))
