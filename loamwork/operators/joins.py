"""As-of, nearest, range and containment joins as bucketed equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scope(name: str) -> Column:
    """Equal scopes, null being a scope of its own."""
    return F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))


def asof_backward(left: DataFrame, right: DataFrame, by: str, tolerance: int) -> DataFrame:
    """Each left row with the last right row of its scope at or up to ``tolerance`` seconds before it.

    left: (id, at, by); right: (id, at, by). Of equal times the largest id counts. One sort of
    both sides together, so no pair is ever formed: the last right row is carried forward, and a
    scope is split over time buckets, each starting with what its predecessor ends with.
    """
    width = max(1, tolerance)
    bucket = F.floor(F.col("at") / width)
    mine = left.select(F.col(by), bucket.alias("b"), "at", F.lit(1).alias("side"), F.col("id").alias("left_id"), F.lit(None).cast("long").alias("right_at"), F.lit(None).alias("right_id"))
    theirs = right.select(
        F.col(by), F.explode(F.array(bucket, bucket + 1)).alias("b"), "at", F.lit(0).alias("side"), F.lit(None).alias("left_id"), F.col("at").alias("right_at"), F.col("id").alias("right_id")
    )
    w = Window.partitionBy(by, "b").orderBy("at", "side", "right_id").rowsBetween(Window.unboundedPreceding, 0)
    both = theirs.unionByName(mine).withColumn("last", F.last(F.when(F.col("side") == 0, F.struct("right_at", "right_id")), ignorenulls=True).over(w))
    near = F.col("at") - F.col("last.right_at") <= tolerance
    return both.where("side = 1").select(
        F.col("left_id").alias("id"), F.col(by), "at", F.when(near, F.col("last.right_id")).alias("right_id"), F.when(near, F.col("last.right_at")).alias("right_at")
    )


def nearest(left: DataFrame, right: DataFrame, by: str, tolerance: int) -> DataFrame:
    """Each left row with the right row of its scope nearest in time, within ``tolerance`` on either side; ties take the smaller id."""
    before = asof_backward(left, right, by, tolerance)
    flipped = asof_backward(
        left.withColumn("at", -F.col("at")), right.withColumn("at", -F.col("at")).withColumn("id", -F.col("id")), by, tolerance
    ).select(F.col("id"), (-F.col("right_id")).alias("next_id"), (-F.col("right_at")).alias("next_at"))
    # equal times before: the smallest id of that very second
    first = right.groupBy(by, "at").agg(F.min("id").alias("first_id"))
    joined = before.join(flipped, "id").alias("l").join(
        first.alias("r"), _scope(by) & (F.col("l.right_at") == F.col("r.at")), "left"
    )
    back = F.when(F.col("l.right_at").isNotNull(), F.struct((F.col("l.at") - F.col("l.right_at")).alias("d"), F.col("first_id").alias("id"), F.col("l.right_at").alias("t")))
    ahead = F.when(F.col("next_at").isNotNull(), F.struct((F.col("next_at") - F.col("l.at")).alias("d"), F.col("next_id").alias("id"), F.col("next_at").alias("t")))
    best = F.least(back, ahead)
    return joined.select(F.col("l.id").alias("id"), best["id"].alias("right_id"), best["d"].alias("distance"))


def line_coverage(lines: DataFrame, windows: DataFrame, share: float = 0.5, width: int = 64) -> DataFrame:
    """Per line, whether its first window's text has ``share`` of its distinctive tokens.

    lines: (doc_id, line, tokens, blank); windows: (doc_id, idx, start_line, end_line, tokens). A line without
    tokens counts, one without a window doesn't. Windows are dealt to blocks of ``width`` lines, so the join is by equality.
    """
    spread = windows.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    keyed = lines.withColumn("b", F.floor(F.col("line") / width)).alias("l")
    on = (F.col("l.doc_id") == F.col("w.doc_id")) & (F.col("l.b") == F.col("w.b")) & F.col("l.line").between(F.col("w.start_line"), F.col("w.end_line"))
    met = keyed.join(spread.alias("w"), on, "left")
    hit = F.size(F.array_intersect("l.tokens", "w.tokens")) >= share * F.size("l.tokens")
    covered = F.when(F.col("w.idx").isNull(), False).when(F.size("l.tokens") == 0, True).otherwise(hit)
    return met.groupBy("l.doc_id", "l.line").agg(F.min(F.struct(F.col("w.idx"), covered.alias("c"))).alias("first")).select("doc_id", "line", F.col("first.c").alias("covered"))


def content_coverage(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, coverage): share of the lines that are not blank."""
    return line_coverage(lines.where("not blank"), windows).groupBy("doc_id").agg(F.round(F.avg(F.col("covered").cast("double")), 6).alias("coverage"))


def best_overlap(passages: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(passage_id, artifact_id): the span that overlaps over half of a passage the most, the lowest ordinal of equals.

    passages: (passage_id, doc_id, start_line, end_line); spans: (artifact_id, doc_id, start_line, end_line, ordinal).
    Over half of a passage includes its middle line, so a passage meets only the spans of the block of ``width`` lines that holds it.
    """
    middle = F.floor((F.col("start_line") + F.col("end_line")) / 2)
    keyed = passages.withColumn("__b", F.floor(middle / width)).withColumn("__m", middle).alias("p")
    spread = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width)))).alias("s")
    on = (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("p.__b") == F.col("s.__b")) & F.col("p.__m").between(F.col("s.start_line"), F.col("s.end_line"))
    over = F.least("p.end_line", "s.end_line") - F.greatest("p.start_line", "s.start_line") + 1
    half = over * 2 > F.col("p.end_line") - F.col("p.start_line") + 1
    top = F.max(F.struct(over.alias("over"), (-F.col("ordinal")).alias("early"), F.col("artifact_id")))
    best = keyed.join(spread, on).where(half).groupBy("passage_id").agg(top.alias("top"))
    return best.select("passage_id", F.col("top.artifact_id").alias("artifact_id"))


def set_containment(left: DataFrame, right: DataFrame, tested: int = 3) -> DataFrame:
    """(left_id, right_id) where every member of a non-empty right set is in the left one. Both: (id, member).

    A pair comes from the right set's rarest member and a left set of no smaller size; one semi join each for the next rarest ones,
    ``tested`` in all, leaves few pairs for the count of the members that are left.
    """
    members, mine = right.select("id", "member").distinct(), left.select("id", "member").distinct()
    often = mine.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "member"))
    placed = members.join(often, "member", "left").select("id", "member", place.alias("place"))
    nth = [F.max(F.when(F.col("place") == k, F.col("member"))).alias(f"m{k}") for k in range(1, tested + 1)]
    wanted = placed.groupBy(F.col("id").alias("right_id")).agg(F.count(F.lit(1)).alias("size"), *nth)
    sized = mine.join(mine.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "id")
    held = mine.select(F.col("id").alias("left_id"), F.col("member").alias("m"))
    found = wanted.join(sized.select(F.col("id").alias("left_id"), F.col("member").alias("m1"), "own"), "m1").where("own >= size and left_id <> right_id").drop("own")
    for k in range(2, tested + 1):
        here = (F.col("f.left_id") == F.col("h.left_id")) & (F.col(f"f.m{k}") == F.col("h.m"))
        larger = found.where(F.col("size") >= k).alias("f").join(held.alias("h"), here, "left_semi")
        found = found.where(F.col("size") < k).unionByName(larger)
    rest = placed.where(F.col("place") > tested).select(F.col("id").alias("right_id"), F.col("member").alias("m"))
    large = found.where(F.col("size") > tested).select("left_id", "right_id", "size")
    whole = large.join(rest, "right_id").join(held, ["left_id", "m"]).groupBy("left_id", "right_id", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("size") - tested)
    return found.where(F.col("size") <= tested).select("left_id", "right_id").unionByName(whole.select("left_id", "right_id"))
