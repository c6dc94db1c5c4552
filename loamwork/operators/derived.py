"""Work derived from sources: undoing it, showing where it came from, and putting parts in a row's place.

``sources`` tables have (child_id, root_id): the child was written from the root. They hold no cycle, as a
source is older than what is written from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.text import token_estimate
from loamwork.operators.dealing import parts_of
from loamwork.operators.lifecycle import healed
from loamwork.storage import discard, materialise

#: Up to so many starts of ranges are broadcast.
FEW = 300_000


def _spread(sources: DataFrame, first: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(id): ``first`` and all that was written from it, a level a step; only what is in ``within``, if given. A source of many children is a join's skewed key, no group."""
    found = front = materialise(first.select("id").distinct(), "derived")
    while True:
        step = sources.join(front.select(F.col("id").alias("root_id")), "root_id").select(F.col("child_id").alias("id")).distinct()
        if within is not None:
            step = step.join(within, "id", "left_semi")
        fresh = materialise(step.join(found, "id", "left_anti"), "derived-front")
        if fresh.isEmpty():
            return found
        more = materialise(found.unionByName(fresh), "derived")
        discard(found)
        if front is not found:
            discard(front)
        found, front = more, fresh


def fates(sources: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, fate) of all that hangs on roots (id) that are to go: ``forgotten``, or ``rederive`` for what still has a source.

    First everything that the roots reach is taken as gone; then what has a source outside of that comes back, and with it what was written from
    it. A root itself never comes back. What comes back lost a source or has one that is to be made anew, so it is made anew as well.
    """
    gone = _spread(sources, roots)
    lost = materialise(gone.join(roots.select("id"), "id", "left_anti"), "derived-lost")
    firm = sources.join(gone.select(F.col("id").alias("root_id")), "root_id", "left_anti").select(F.col("child_id").alias("id"))
    back = _spread(sources, firm.join(lost, "id", "left_semi"), lost)
    return gone.join(back.withColumn("__back", F.lit(True)), "id", "left").select("id", F.when(F.col("__back"), "rederive").otherwise("forgotten").alias("fate"))


def forget_derived(art: DataFrame, sources: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts, sources and jobs (stage, target_id) after ``roots`` went: forgotten rows and their sources are gone, and what they replaced is active again; what has a source left is queued."""
    fate = materialise(fates(sources, roots), "derived-fates")
    gone = fate.where("fate = 'forgotten'").select("id")
    left = healed(art.join(gone, "id", "left_anti").select(*art.columns))
    kept = sources.join(gone.select(F.col("id").alias("child_id")), "child_id", "left_anti").join(gone.select(F.col("id").alias("root_id")), "root_id", "left_anti")
    return left, kept.select(*sources.columns), fate.where("fate = 'rederive'").select(F.lit("rederive").alias("stage"), F.col("id").alias("target_id"))


def lineage_tree(sources: DataFrame, roots: DataFrame, most: int = 200, depth: int = 6, parts: int | None = None) -> DataFrame:
    """(root, node, parent, depth, place, truncated): what each asked artifact (id) was written from, ``most`` nodes at most.

    sources: (child_id, root_id, via); ``via`` is the artifact through which a source came in, which stands between as the common parent of all that came through it,
    and is looked into in turn; null or the source itself for one that came in directly. Levels are decided from the top:
    a level's nodes go by their parents' places, direct ones first, then by id, and those beyond the budget are left out. An intermediate
    that a root meets again deeper is not repeated; one without sources of its own shows those that came through it. ``truncated`` says whether the root's tree was cut.
    Links and levels are dealt to ``parts`` tasks, by default as many as the sources' rows ask for.
    """
    through = F.col("via").isNotNull() & (F.col("via") != F.col("root_id"))
    parts = parts or parts_of(sources.sparkSession, sources.count())
    named = sources.select("child_id", F.when(through, F.col("via")).otherwise(F.col("root_id")).alias("node"), through.cast("int").alias("via"))
    links = materialise(named.repartition(parts, "child_id", "node").distinct(), "tree-links")
    # what came through an intermediate that has no rows itself
    between = links.where("via = 1").select(F.col("node").alias("child_id")).repartition(parts, "child_id").distinct()
    lone_ids = materialise(between.join(links.select("child_id").repartition(parts, "child_id"), "child_id", "left_anti"), "tree-lone")
    bare = None
    if not lone_ids.isEmpty():
        bare = sources.where(through).select(F.col("via").alias("child_id"), F.col("root_id").alias("node"), F.col("child_id").alias("over"))
        bare = materialise(bare.repartition(parts, "child_id").join(lone_ids.repartition(parts, "child_id"), "child_id", "left_semi").distinct(), "tree-bare")
    kind = roots.schema["id"].dataType
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"), F.lit(1).alias("via"), F.lit(False).alias("cut"))
    seen = front = materialise(start.distinct(), "tree")
    for d in range(1, depth + 2):
        ahead = front.where("via = 1").select("root", F.col("node").alias("child_id"), F.col("place").alias("above"), F.col("parent").alias("over"))
        ahead = ahead.repartition(parts, "child_id")
        met = ahead.join(links.repartition(parts, "child_id"), "child_id").select("root", "node", F.col("child_id").alias("parent"), "above", "via")
        if bare is not None:
            lone = ahead.join(bare.repartition(parts, "child_id"), ["child_id", "over"])
            met = met.unionByName(lone.select("root", "node", F.col("child_id").alias("parent"), "above", F.lit(0).alias("via")))
        before = seen.where("via = 1").select("root", "node", F.lit(1).alias("via"))
        met = met.repartition(parts, "root", "node", "via").join(before.repartition(parts, "root", "node", "via"), ["root", "node", "via"], "left_anti")
        # an intermediate under several parents of one level hangs under the first
        once = met.withColumn("n", F.row_number().over(Window.partitionBy("root", "node", "via", F.when(F.col("via") == 0, F.col("parent"))).orderBy("above"))).where("n = 1")
        used = seen.select("root", "place").repartition(parts, "root").groupBy("root").agg((F.max("place") + 1).alias("used"))
        place = F.col("used") + F.row_number().over(Window.partitionBy("root").orderBy("above", "via", "node")) - 1
        # one row beyond the budget stays, to tell that there was more
        level = once.repartition(parts, "root").join(used, "root").withColumn("place", place).where(F.col("place") <= most + 1)
        over = (F.col("place") > most) | F.lit(d > depth)
        fresh = materialise(level.select("root", "node", "parent", F.lit(d).alias("depth"), "place", "via", over.alias("cut")), "tree-level")
        if fresh.isEmpty():
            break
        seen, front = materialise(seen.unionByName(fresh), "tree"), fresh.where("not cut")
    dealt = seen.repartition(parts, "root")
    cut = dealt.groupBy("root").agg(F.max("cut").alias("truncated"))
    return dealt.where("not cut and depth > 0").join(cut, "root").select("root", "node", "parent", "depth", "place", "truncated")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``, each row's place from 0 among those of its ``by``, without gaps. Ranges of the whole order number their own rows, so no list is ever one task's work."""
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange(*by, *order, "__tie").sortWithinPartitions(*by, *order, "__tie").drop("__tie")
    kept = materialise(ranged.withColumn("__pos", F.monotonically_increasing_id()), "numbered").withColumn("__range", F.shiftright("__pos", 33))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(*by, "__range").agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
    starts = materialise(starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), "numbered-starts")
    few = starts.count() <= FEW
    return kept.join(F.broadcast(starts) if few else starts, [*by, "__range"]).withColumn(name, F.col("__pos") - F.col("__first") + F.col("__before")).select(*rows.columns, name)


def spliced(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(list_id, ordinal, id, part, origin, text): ordered lists in which some rows gave way to their parts.

    rows: (list_id, ordinal, id, text); parts: (id, part, text), what a row was cut into; a row without parts stays as it is, and one whose only part has a null text goes.
    Ordinals are gapless from 0 in the rows' order, then that of parts, then by their text. ``origin`` is the row that a part was cut from, null for a row that stayed.
    """
    cut = parts.select("id", F.col("part").cast("long").alias("part"), F.col("text").alias("__text"), F.lit(True).alias("__cut"))
    met = rows.join(cut, "id", "left").where("__cut is null or __text is not null")
    text = F.when(F.col("__cut"), F.col("__text")).otherwise(F.col("text"))
    flat = met.select("list_id", "id", F.col("ordinal").alias("__at"), "part", F.when(F.col("__cut"), F.col("id")).alias("origin"), text.alias("text"))
    return numbered(flat, ["list_id"], ["__at", "id", "part", "text"], "ordinal").select("list_id", "ordinal", "id", "part", "origin", "text")


def embed_routes(art: DataFrame, limit: int, batch: int = 32) -> DataFrame:
    """(id, corpus_id, route, batch): of artifacts (id, corpus_id, ordinal, text) that wait for a vector, those too long for the model are ``split``, each by itself; the others go in batches of a corpus."""
    long = token_estimate(F.coalesce("text", F.lit(""))) > limit
    routed = art.select("id", "corpus_id", "ordinal", F.when(long, "split").otherwise("batch").alias("route"))
    placed = numbered(routed, ["corpus_id", "route"], ["ordinal", "id"], "place")
    return placed.select("id", "corpus_id", "route", F.when(F.col("route") == "batch", F.floor(F.col("place") / batch)).alias("batch"))


def _fitting(lines: Column, budget: int) -> Column:
    """How many of the first lines fit, a token for each line end."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(at: Column, line: Column) -> Column:
        used = at["used"] + token_estimate(line).cast("long") + 1
        return F.when(at["open"] & (used <= budget), F.struct(used.alias("used"), (at["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(at["used"].alias("used"), at["n"].alias("n"), F.lit(False).alias("open")))

    return F.aggregate(lines, start, take)["n"]


def head_within(text: Column, budget: int) -> Column:
    """As many whole lines from the start as fit into a number of tokens; if not even one does, as many characters; null for no text or budget."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n")
    n = _fitting(lines, budget)
    return F.when((F.lit(budget) > 0) & (F.coalesce(text, F.lit("")) != ""), F.when(n > 0, F.array_join(F.slice(lines, F.lit(1), n), "\n")).otherwise(F.substring(text, 1, max(16, budget * 7 // 2))))


def tail_within(text: Column, budget: int) -> Column:
    """The same from the end, in the text's own order."""
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\r?\n")
    n = _fitting(F.reverse(lines), budget)
    most = max(16, budget * 7 // 2)
    end = F.when(F.char_length(text) > most, F.substring(text, -most, most)).otherwise(text)
    return F.when((F.lit(budget) > 0) & (F.coalesce(text, F.lit("")) != ""), F.when(n > 0, F.array_join(F.slice(lines, F.size(lines) - n + 1, n), "\n")).otherwise(end))


def window_context(windows: DataFrame, opening: int = 200, overlap: int = 100) -> DataFrame:
    """(doc_id, idx, opening, before, after): what a reader of one window (doc_id, idx, text) should see of its document, in tokens at most: the first window's head, the end of
    the window before and the head of the one after. The cuts are made before windows meet, so rows that are joined are no larger than the budgets."""
    cut = windows.select("doc_id", "idx", head_within(F.col("text"), opening).alias("o"), head_within(F.col("text"), overlap).alias("h"), tail_within(F.col("text"), overlap).alias("t"))
    mine = cut.select("doc_id", "idx")
    first = cut.where("idx = 0").select("doc_id", F.col("o").alias("opening"))
    before = cut.select("doc_id", (F.col("idx") + 1).alias("idx"), F.col("t").alias("before"))
    after = cut.select("doc_id", (F.col("idx") - 1).alias("idx"), F.col("h").alias("after"))
    met = mine.join(before, ["doc_id", "idx"], "left").join(after, ["doc_id", "idx"], "left").join(first, "doc_id", "left")
    return met.select("doc_id", "idx", F.when(F.col("idx") > 0, F.col("opening")).alias("opening"), "before", "after")
