"""Whole searches and rounds of questions, composed of the retrieval operators, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators import retrieval
from loamwork.operators.lifecycle import active
from loamwork.operators.retrieval import ranked
from loamwork.storage import materialise

#: The doors whose searches are recorded, and those that neither prime nor associate.
CAPTURED = ("ui", "api", "mcp", "extension")
PLAIN = ("ask", "judge")
WIDER = 3


def captured(door: Column) -> Column:
    """Whether a door's searches go into the log; an unknown one's don't."""
    return F.coalesce(door.isin(*CAPTURED), F.lit(False))


def claimed_door(raw: Column) -> Column:
    """The door that a client may claim: the extension, else the interface for programs."""
    return F.when(raw == "extension", raw).otherwise(F.lit("api"))


def candidate_width(limit: int, capped: bool = False, reranked: bool = False, recorded: int = 0) -> int:
    """How many candidates to fetch for ``limit`` results: three times as many where some are displaced or reordered, and what a log records at least."""
    return max(limit * WIDER if capped or reranked else limit, recorded)


def query_vectors(queries: DataFrame, embed) -> DataFrame:
    """(q_id, text, vector): each text that differs by more than white space is embedded once. ``embed``: from a column of texts to one of vectors."""
    text = F.btrim(F.regexp_replace("text", r"\s+", " "))
    keyed = queries.select("q_id", "text", text.alias("__key"))
    vectors = keyed.select("__key").distinct().select("__key", embed(F.col("__key")).alias("vector"))
    return keyed.join(vectors, "__key").select("q_id", "text", "vector")


def annotated(hits: DataFrame) -> DataFrame:
    """Adds what a result says of itself. Needs provenance and origins."""
    written = F.coalesce(F.col("provenance").isin("merged", "synthesized"), F.lit(False))
    made = F.coalesce(F.col("provenance") == "synthesized", F.lit(False))
    return hits.withColumn("model_written", written).withColumn("synthesized", made).withColumn("origin_count", F.when(F.col("origins").isNotNull(), F.size("origins")).otherwise(0))


def answered(hits: DataFrame) -> DataFrame:
    """(q_id, answered): whether a query's first result was written for such questions, and isn't weak. Needs provenance and weak."""
    first = hits.where("rank = 0")
    return first.select("q_id", F.coalesce((F.col("provenance") == "synthesized") & ~F.col("weak"), F.lit(False)).alias("answered"))


def random_artifact(art: DataFrame, seed: int, n: int = 1) -> DataFrame:
    """``n`` artifacts in results, drawn by a hash of seed and id, so the same draw comes again."""
    return art.where(active()).orderBy(F.xxhash64(F.lit(seed), F.col("id").cast("string")), "id").limit(n)


def search(
    art: DataFrame,
    queries: DataFrame,
    at: int,
    limit: int = 10,
    cap: int | None = None,
    scorer: Column | None = None,
    recorded: int = 0,
    activation: DataFrame | None = None,
    links: DataFrame | None = None,
    weak_below: float = 0.35,
    **filters,
) -> DataFrame:
    """(q_id, id, rank, score, similarity, weak, past_cliff, associated) of every query.

    art: (id, corpus_id, text, vector, tags, status, verified_at); queries: (q_id, text, vector). The dense and the
    lexical branch are fused by rank, or the dense one alone counts where a query has no term; then come recency and the pinned boost,
    the cap on hits of one corpus, ``scorer``, priming by ``activation`` (id, activation, sitting), the cut at
    ``limit``, the cliff, and after the last hit what ``links`` recall. ``filters`` are those of ``retrieval.filter_artifacts``.
    Queries without a word or a vector have no results.
    """
    live = retrieval.filter_artifacts(art, **filters)
    asked = queries.where(F.btrim(F.coalesce("text", F.lit(""))) != "")
    width = candidate_width(limit, cap is not None, scorer is not None, recorded)
    dense = materialise(retrieval.dense_topk(live.select("id", "vector"), asked.select("q_id", "vector"), width), "search-dense")
    lexical = materialise(retrieval.bm25_topk(live.select("id", "text"), asked.select("q_id", "text"), width), "search-lexical")
    terms = retrieval.postings(asked.select(F.col("q_id").alias("id"), "text")).select(F.col("id").alias("q_id"))
    fused = retrieval.dense_where_lexical_is_silent(retrieval.rrf_fusion([dense, lexical], limit=width), dense, terms)
    hits = retrieval.final_score(fused.join(live.select("id", "corpus_id", "text", "tags", "verified_at"), "id"), at)
    hits = retrieval.with_similarity(hits, dense, weak_below)
    if cap is not None:
        hits = retrieval.diversity_cap(hits, "corpus_id", cap, width).drop("displaced")
    if scorer is not None:
        asked_text = asked.select("q_id", F.col("text").alias("query"))
        hits = retrieval.rerank(hits.join(asked_text, "q_id"), scorer, max(limit, recorded)).drop("old_rank", "query")
    if activation is not None:
        hits = retrieval.prime(hits.join(activation.select("id", "activation", "sitting"), "id", "left").withColumn("sitting", F.coalesce("sitting", F.lit(False)))).drop("primed", "activation", "sitting")
    shape = ["q_id", "id", "rank", "score", "similarity", "weak", "past_cliff", "associated"]
    # read twice, for the cliff and for what lies beyond it
    hits = materialise(hits.where(F.col("rank") < limit).select(*shape[:5], "weak"), "search-hits")
    shown = retrieval.mark_past_cliff(hits).withColumn("associated", F.lit(False)).select(*shape)
    if links is None:
        return shown
    recalled = retrieval.associated(shown.select("q_id", "id", "rank"), links, at).join(live.select("id"), "id", "left_semi")
    last = shown.groupBy("q_id").agg(F.max("rank").alias("last"))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy("place"))
    no = F.lit(False)
    after = recalled.join(last, "q_id").select(
        "q_id", "id", (F.col("last") + place).alias("rank"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("similarity"), no.alias("weak"), no.alias("past_cliff"), F.lit(True).alias("associated")
    )
    return shown.unionByName(after)


def planned(questions: DataFrame, most: int = 3) -> DataFrame:
    """(q_id, part, text): the first ``most`` filled queries of each plan, those that differ by more than case. questions: (q_id, plan array<string>)."""
    each = questions.select("q_id", F.posexplode("plan").alias("pos", "raw")).select("q_id", "pos", F.btrim("raw").alias("text")).where("text <> ''")
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("q_id", F.lower("text")).orderBy("pos"))).where("n = 1")
    return first.withColumn("part", F.row_number().over(Window.partitionBy("q_id").orderBy("pos")) - 1).where(F.col("part") < most).select("q_id", "part", "text")


def reach(hits: DataFrame, art: DataFrame, links: DataFrame, at: int, anchors: int = 3, most: int = 6, show_min: float = 2.0, half_life_days: float = 30) -> DataFrame:
    """(q_id, id, via, place): what lies beside the first hits of each query, ``most`` at most, none of them a hit.

    Of each of the first ``anchors`` hits above the cliff: its neighbours in its corpus, the one before first, then its
    strongest links. The first way to an artifact counts. hits: (q_id, id, rank), cut at the cliff; art needs corpus_id, ordinal, status, superseded_by.
    """
    from_ = hits.where(F.col("rank") < anchors).select("q_id", F.col("rank").alias("anchor"), F.col("id").alias("via"))
    live = art.where(active())
    sides = retrieval.adjacent(live).select(F.col("id").alias("via"), F.posexplode(F.array("before", "after")).alias("way", "id")).where("id is not null")
    beside = from_.join(sides, "via").select("q_id", "anchor", "via", F.col("way").cast("long").alias("way"), "id")
    linked = retrieval.links_from(links, hits.where(F.col("rank") < anchors), at, half_life_days).where(F.col("weight") >= show_min)
    strongest = linked.withColumn("n", F.row_number().over(Window.partitionBy("q_id", "anchor_rank").orderBy(F.desc("weight"), "id"))).where(F.col("n") <= most)
    joined = strongest.join(from_, (strongest.q_id == from_.q_id) & (strongest.anchor_rank == from_.anchor)).select(strongest.q_id, "anchor", "via", (F.col("n") + 1).cast("long").alias("way"), strongest.id)
    every = beside.unionByName(joined)
    first = every.withColumn("k", F.row_number().over(Window.partitionBy("q_id", "id").orderBy("anchor", "way"))).where("k = 1")
    fresh = first.join(hits.select("q_id", "id"), ["q_id", "id"], "left_anti").join(live.select("id"), "id", "left_semi")
    return ranked(fresh, "anchor", "way", limit=most).select("q_id", "id", "via", F.col("rank").alias("place"))


def ask_rounds(art: DataFrame, parts: DataFrame, links: DataFrame, at: int, limit: int = 8, **filters) -> DataFrame:
    """(q_id, id, kind, rank): the evidence for each question, of all its planned queries.

    parts: (q_id, part, text, vector), part below 16. Each is searched without a cap, cut at its cliff, and reaches sideways; then the rounds are merged.
    """
    keyed = parts.select((F.col("q_id") * 16 + F.col("part")).alias("q_id"), "text", "vector")
    hits = materialise(search(art, keyed, at, limit, **filters).select("q_id", "id", "rank", "score"), "ask-hits")
    cut = retrieval.cliff(hits)
    above = hits.join(cut, "q_id", "left").where(F.col("cliff_at").isNull() | (F.col("rank") < F.col("cliff_at")))
    sideways = reach(above.select("q_id", "id", "rank"), art, links, at).join(cut, "q_id", "left")
    shape = lambda h, kind, rank: h.select(F.floor(F.col("q_id") / 16).alias("q_id"), (F.col("q_id") % 16).alias("part"), F.col(rank).alias("rank"), "id", F.lit(kind).alias("kind"), "cliff_at")
    return retrieval.merge_rounds(shape(above, "ranked", "rank").unionByName(shape(sideways, "reached", "place")))


def excerpt_budget(hits: DataFrame, tokens: str, budget: int) -> DataFrame:
    """(q_id, kept, dropped): how many of each query's hits fit, in order, and how many don't."""
    running = F.sum(tokens).over(Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fits = hits.withColumn("__fits", running <= budget)
    return fits.groupBy("q_id").agg(F.count_if(F.col("__fits")).alias("kept"), F.count_if(~F.col("__fits")).alias("dropped"))


def seen_effects(hits: DataFrame, at: int, opened: float = 0.5) -> DataFrame:
    """(id, at, hits, gain): what a shown list does to its artifacts: all are seen; retrieved ones, not recalled ones, count a hit and gain activation. Needs associated."""
    n = F.count_if(~F.col("associated"))
    return hits.groupBy("id").agg(n.alias("hits"), (n * opened).alias("gain")).select("id", F.lit(at).cast("long").alias("at"), "hits", "gain")
