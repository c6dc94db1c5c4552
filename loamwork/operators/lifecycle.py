"""State changes of artifacts, corpora and links as column transforms over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.text import decayed
from loamwork.operators.dealing import beside


def active(prefix: str = "") -> Column:
    """In results: active and not superseded."""
    return (F.coalesce(F.col(f"{prefix}status"), F.lit("active")) == "active") & F.col(f"{prefix}superseded_by").isNull()


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; where both have a key, the new value unless it is null. A key is unique on either side."""
    a, b = table.alias("a"), new.alias("b")
    cols = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}") for c in table.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def supersede(art: DataFrame, commands: DataFrame) -> DataFrame:
    """commands (id, winner_id): the loser is superseded if both are in results and differ; the first winner of several is the smallest."""
    one = commands.where("id <> winner_id").groupBy("id").agg(F.min("winner_id").alias("winner_id"))
    live = art.where(active()).select(F.col("id").alias("winner_id"))
    valid = one.join(live, "winner_id", "left_semi")
    # a winner of this batch is not superseded by it
    valid = valid.join(valid.select(F.col("winner_id").alias("id")), "id", "left_anti")
    joined = art.join(valid, "id", "left").withColumn("__hit", active() & F.col("winner_id").isNotNull())
    hit = F.col("__hit")
    return joined.withColumn("superseded_by", F.when(hit, F.col("winner_id")).otherwise(F.col("superseded_by"))).withColumn("status", F.when(hit, "superseded").otherwise(F.col("status"))).drop("winner_id", "__hit")


def unsupersede(art: DataFrame, ids: DataFrame) -> DataFrame:
    hit = F.col("__hit").isNotNull() & F.col("superseded_by").isNotNull()
    joined = art.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return joined.withColumn("status", F.when(hit, "active").otherwise(F.col("status"))).withColumn("superseded_by", F.when(~hit, F.col("superseded_by"))).drop("__hit")


def deprecate(art: DataFrame, ids: DataFrame) -> DataFrame:
    """Refused for superseded artifacts."""
    joined = art.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return joined.withColumn("status", F.when(F.col("__hit").isNotNull() & F.col("superseded_by").isNull(), "deprecated").otherwise(F.col("status"))).drop("__hit")


def verify(art: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Stamps artifacts and sets their hits to zero."""
    joined = art.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    hit = F.col("__hit").isNotNull()
    return joined.withColumn("verified_at", F.when(hit, F.lit(at)).otherwise(F.col("verified_at"))).withColumn("hit_count", F.when(hit, 0).otherwise(F.col("hit_count"))).drop("__hit")


def healed(art: DataFrame) -> DataFrame:
    """Pointers to artifacts that are gone are dropped and their owners active again."""
    known = art.select(F.col("id").alias("superseded_by"), F.lit(True).alias("__known"))
    joined = art.join(known, "superseded_by", "left")
    lost = F.col("superseded_by").isNotNull() & F.col("__known").isNull()
    return joined.withColumn("status", F.when(lost, "active").otherwise(F.col("status"))).withColumn("superseded_by", F.when(~lost, F.col("superseded_by"))).drop("__known").select(*art.columns)


def without_corpora(art: DataFrame, corpora: DataFrame) -> DataFrame:
    """Artifacts that are left when corpora (id) go."""
    return healed(art.join(corpora.select(F.col("id").alias("corpus_id")), "corpus_id", "left_anti").select(*art.columns))


def resolve_near_duplicates(corpora: DataFrame, choices: DataFrame) -> DataFrame:
    """choices (id, near_id, action): replace drops the older, discard the newer, keep_both releases it."""
    gone = choices.where("action = 'replace'").select(F.col("near_id").alias("id")).union(choices.where("action = 'discard'").select("id"))
    freed = choices.where("action in ('replace', 'keep_both')").select("id", F.lit(True).alias("__free")).distinct()
    left = corpora.join(gone, "id", "left_anti").join(freed, "id", "left")
    return left.withColumn("status", F.when(F.col("__free").isNotNull(), "queued").otherwise(F.col("status"))).drop("__free")


def renumbered(art: DataFrame) -> DataFrame:
    """Ordinals 0, 1, ... within each corpus, by segment, old ordinal and id."""
    w = Window.partitionBy("corpus_id").orderBy(F.coalesce("segment_idx", F.lit(0)), "ordinal", "id")
    return art.withColumn("ordinal", F.row_number().over(w) - 1)


def make_room(art: DataFrame, after: DataFrame) -> DataFrame:
    """Shifts ordinals: after (corpus_id, position, n), later ones move up by n."""
    joined = art.join(after, "corpus_id", "left")
    return joined.withColumn("ordinal", F.col("ordinal") + F.when(F.col("ordinal") > F.col("position"), F.col("n")).otherwise(0)).drop("position", "n")


def carry_links(links: DataFrame, moved: DataFrame, at: int, half_life_days: float = 30, parts: int | None = None) -> DataFrame:
    """Links after artifacts moved (old_id, new_id): the larger decayed weight of links that fall together; a dismissal stays. ``parts``: in how many tasks, the session's number if not said."""
    a, b = moved.select(F.col("old_id").alias("a_id"), F.col("new_id").alias("na")), moved.select(F.col("old_id").alias("b_id"), F.col("new_id").alias("nb"))
    both = beside(beside(links, a, "a_id", parts), b, "b_id", parts)
    x, y = F.coalesce("na", "a_id"), F.coalesce("nb", "b_id")
    weight = F.round(decayed(F.col("weight"), F.col("bumped_at"), at, half_life_days), 6)
    ends = both.select(F.least(x, y).alias("a_id"), F.greatest(x, y).alias("b_id"), weight.alias("weight"), "state").where("a_id <> b_id")
    ends = ends.repartition(parts, "a_id", "b_id") if parts else ends
    state = F.when(F.max(F.col("state") == "dismissed"), "dismissed").otherwise(F.max("state"))
    return ends.groupBy("a_id", "b_id").agg(F.max("weight").alias("weight"), state.alias("state"))


def interpreted(verdicts: DataFrame) -> DataFrame:
    """State of judged pairs: (a_id, b_id, a_created, b_created, verdict, replaced_id, n_lost).

    A replacement must name the older one; a duplicate that would lose something is a conflict.
    """
    older = F.when(F.col("a_created") <= F.col("b_created"), F.col("a_id")).otherwise(F.col("b_id"))
    state = (
        F.when((F.col("verdict") == "replaced") & (F.col("replaced_id") == older), "settled")
        .when(F.col("verdict") == "replaced", "conflict")
        .when((F.col("verdict") == "duplicate") & (F.coalesce("n_lost", F.lit(0)) > 0), "conflict")
        .when(F.col("verdict") == "duplicate", "mergeable")
        .when(F.col("verdict") == "distinct", "dismissed")
        .otherwise("pending")
    )
    return verdicts.select("a_id", "b_id", state.alias("state"))


def settled_corpora(art: DataFrame) -> DataFrame:
    """(corpus_id, state): ready when every artifact is embedded, partial when one failed, else pending."""
    per = art.groupBy("corpus_id").agg(F.count_if(F.col("embed_state") == "pending").alias("p"), F.count_if(F.col("embed_state") == "failed").alias("f"))
    return per.select("corpus_id", F.when(F.col("p") > 0, "pending").when(F.col("f") > 0, "partial").otherwise("ready").alias("state"))


def carried_tags(drafts: DataFrame) -> DataFrame:
    """(draft_id, tags): the draft's and its roots', in the order first seen. drafts: (draft_id, place, tags), the draft's own place first."""
    grouped = drafts.groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("place", "tags"))).alias("t"))
    return grouped.select("draft_id", F.array_distinct(F.flatten(F.transform("t", lambda x: F.coalesce(x["tags"], F.array().cast("array<string>"))))).alias("tags"))
