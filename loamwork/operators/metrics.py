"""Evaluation of retrieval and answers, and the gaps a base could not answer. Ranks count from 0; a miss has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.retrieval import cosine_counts
from loamwork.storage import materialise

DIGITS = 6


def _rate(x):
    return F.round(F.coalesce(F.avg(x), F.lit(0.0)), DIGITS)


def retrieval_metrics(ranks: DataFrame, k: int = 10) -> DataFrame:
    """One row: n, recall_at_k, mrr. ranks: (rank), null for a miss; no rows give zeros."""
    return ranks.agg(
        F.count(F.lit(1)).alias("n"), _rate(F.when(F.col("rank") < k, 1.0).otherwise(0.0)).alias("recall_at_k"), _rate(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))).alias("mrr")
    )


def judged_ranks(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """(event_id, verdict, rank): where a judged event's expected artifact stood, null if it was not among the candidates."""
    at = candidates.select("event_id", F.col("id").alias("expected"), "rank")
    return events.where("verdict is not null").join(at, ["event_id", "expected"], "left").select("event_id", "verdict", "rank")


def feedback_stats(events: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """One row over the search log, in one pass over it."""
    at = candidates.select("event_id", F.col("id").alias("expected"), "rank")
    joined = events.join(at, ["event_id", "expected"], "left")
    hit = F.col("verdict") == "hit"
    return joined.agg(
        F.count(F.lit(1)).alias("captured"),
        F.count_if(F.col("verdict").isNull()).alias("pending"),
        F.count_if(hit).alias("hits"),
        F.count_if(F.col("verdict") == "gap").alias("gaps"),
        F.count_if(F.col("verdict") == "discard").alias("discards"),
        F.count_if(hit & F.col("rank").isNotNull()).alias("finds"),
        _rate(F.when(hit, F.when(F.col("rank") < k, 1.0).otherwise(0.0))).alias("recall_at_k"),
        _rate(F.when(hit, F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0)))).alias("mrr"),
    )


def misses(events: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """Judged hits whose artifact was not within the first ``k``."""
    return judged_ranks(events, candidates).where("verdict = 'hit'").where(F.col("rank").isNull() | (F.col("rank") >= k))


def citation_recall(questions: DataFrame) -> DataFrame:
    """One row: share of questions that cite one of what they should; 1 without any. questions: (expected array, cited array)."""
    carrying = questions.where(F.size("expected") > 0)
    return carrying.agg(F.round(F.coalesce(F.avg(F.arrays_overlap("expected", "cited").cast("double")), F.lit(1.0)), DIGITS).alias("citation_recall"))


def abstention_table(answers: DataFrame) -> DataFrame:
    """One row of counts. answers: (should_abstain, abstained)."""
    s, a = F.col("should_abstain"), F.col("abstained")
    return answers.agg(F.count_if(s & a).alias("rightly"), F.count_if(s & ~a).alias("made_up"), F.count_if(~s & a).alias("held_back"), F.count_if(~s & ~a).alias("answered"))


def support_rates(claims: DataFrame) -> DataFrame:
    """One row: fully supported answers, and the share of claims without support. claims: (answer_id, sources array, n_sources)."""
    ok = F.size(F.filter("sources", lambda s: (s >= 1) & (s <= F.col("n_sources")))) > 0
    per = claims.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("supported"))
    return per.agg(
        F.count_if(F.col("n") == F.col("supported")).alias("fully_supported"), F.round(F.coalesce(1 - F.sum("supported") / F.sum("n"), F.lit(0.0)), DIGITS).alias("unsupported_rate")
    )


def offer_rates(interactions: DataFrame) -> DataFrame:
    """(rung, shown, opened) of offers by the rung in their JSON detail; unknown where there is none."""
    rung = F.coalesce(F.get_json_object("detail", "$.rung"), F.lit("unknown"))
    return interactions.groupBy(rung.alias("rung")).agg(F.count_if(F.col("kind") == "recommended_shown").alias("shown"), F.count_if(F.col("kind") == "recommended_open").alias("opened"))


def link_threshold(vectors: DataFrame, percentile: float = 0.99, low: float = 0.55, high: float = 0.90, least: int = 30) -> DataFrame:
    """One row (threshold): the nearest-rank percentile of all pair cosines, rounded up to a hundredth and clamped.

    vectors: (id, vector), a sample or all of a table: pairs are counted by their score, never listed. Under ``least`` rows the low bound stands.
    """
    scores = materialise(cosine_counts(vectors), "score-counts")
    running = F.sum("n").over(Window.orderBy("score"))
    total = scores.agg(F.sum("n").alias("total"))
    at = F.floor((F.col("total") - 1) * percentile + 0.5)
    found = scores.withColumn("upto", running).join(F.broadcast(total)).where(F.col("upto") > at).agg(F.min("score").alias("s"))
    sized = vectors.agg(F.count(F.lit(1)).alias("k"))
    raised = F.ceil(F.round(F.col("s") * 100, 4)) / 100
    return found.join(F.broadcast(sized)).select(F.when(F.col("k") < least, low).otherwise(F.coalesce(F.least(F.greatest(raised, F.lit(low)), F.lit(high)), F.lit(low))).cast("double").alias("threshold"))


def unmatched(events: DataFrame, candidates: DataFrame, weak: float = 0.35) -> DataFrame:
    """Events whose best known similarity is weak; events without any candidate are no gap."""
    best = candidates.groupBy("event_id").agg(F.max("similarity").alias("best"))
    return events.join(best, "event_id").where(F.col("best") < weak)


def open_gaps(kinds: dict[str, DataFrame], covered: DataFrame, most: int = 500) -> DataFrame:
    """(kind, id, text, at, place): uncovered gaps of each kind, the newest ``most`` of each. Each: (id, text, at); covered: (kind, id)."""
    out = None
    for kind, events in sorted(kinds.items()):
        part = events.select(F.lit(kind).alias("kind"), "id", "text", "at")
        out = part if out is None else out.unionByName(part)
    left = out.join(covered.select("kind", "id"), ["kind", "id"], "left_anti")
    w = Window.partitionBy("kind").orderBy(F.desc("at"), F.desc("id"))
    return left.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < most)


def gap_rows(clusters: DataFrame, gaps: DataFrame) -> DataFrame:
    """(key, kind, id): members of clusters that are still open, and open gaps of no cluster under a null key. clusters: (key, members array<kind,id>)."""
    members = clusters.select("key", F.explode("members").alias("m")).select("key", "m.kind", "m.id")
    held = members.join(gaps.select("kind", "id"), ["kind", "id"], "left_semi")
    loose = gaps.select("kind", "id").join(members, ["kind", "id"], "left_anti")
    return held.unionByName(loose.withColumn("key", F.lit(None).cast("string")))


def terms_label(texts: DataFrame, group: str, most: int = 3) -> DataFrame:
    """(group, label): the most frequent content words of more than two bytes, count falling, word rising, joined by dots."""
    from loamwork.functions.text import STOP_WORDS

    words = texts.select(group, F.explode(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+")).alias("w")).where(F.octet_length("w") > 2)
    counted = words.select(group, F.lower("w").alias("w")).where(~F.col("w").isin(*STOP_WORDS)).groupBy(group, "w").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "w")
    top = counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]), " · ").alias("label"))
