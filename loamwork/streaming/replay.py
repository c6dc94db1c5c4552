"""Links learned from a stream of searches, each event once however often its batch is run.

Each batch's gains are a generation of their own, numbered by the batch: rows and cursor count from the moment its manifest
is there, together. A batch that is run again after a restart finds its manifest and does nothing, or overwrites what it had begun.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions.text import decayed
from loamwork.operators.logs import DIGITS, shown_pairs
from loamwork.sources.generations import Generations

HALF_LIFE = 30.0


def learn_links(store: Generations, step: float = 1.0, half_life_days: float = HALF_LIFE) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on events (event_id, at, ids): gains of the pairs shown together, ids in their ranks' order, decayed to the batch's latest event."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        number = batch_id + 1
        if store.manifest(number) is not None:
            return
        before = cursor(store)
        latest = batch.agg(F.max("at")).first()[0]
        upto = max(x for x in (before, latest, 0) if x is not None)
        shown = batch.select("event_id", "at", F.posexplode("ids").alias("rank", "id"))
        pairs = shown_pairs(shown.select("event_id", "id", "rank")).join(batch.select("event_id", "at"), "event_id")
        gain = decayed(F.lit(float(step)), F.col("at"), upto, half_life_days)
        gained = pairs.groupBy("a_id", "b_id").agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("n_events"))
        store.write(gained.withColumn("upto", F.lit(upto).cast("long")), number, cursor=upto)

    return commit


def cursor(store: Generations) -> int | None:
    """Time of the latest event that was learned from; null before the first batch."""
    numbers = store.numbers()
    return store.manifest(numbers[-1])["cursor"] if numbers else None


def learned_links(store: Generations, at: int, half_life_days: float = HALF_LIFE) -> DataFrame:
    """(a_id, b_id, weight, n_events) of all committed batches at a time: what decayed to a batch's end goes on decaying from there."""
    numbers = store.numbers()
    kinds = store.manifest(numbers[-1])["schema"] if numbers else "a_id long, b_id long, gain double, n_events long, upto long"
    rows = store.spark.read.schema(kinds).parquet(*[f"{store.folder}/g{n}" for n in numbers]) if numbers else store.spark.createDataFrame([], kinds)
    weight = F.sum(decayed(F.col("gain"), F.col("upto"), at, half_life_days))
    return rows.groupBy("a_id", "b_id").agg(F.round(weight, DIGITS).alias("weight"), F.sum("n_events").alias("n_events"))
