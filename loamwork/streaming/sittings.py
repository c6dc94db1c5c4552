"""What a sitting has touched and asked, kept as state with a time to live, and the same over a table.

Events: (scope, id, at, artifact_id, query), of which one of the last two is null; ids order events of one second. A sitting ends with ``idle`` seconds without an event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loamwork.operators.logs import sessions

CARRIED = 20
_LISTS = [T.StructField("last_at", T.LongType()), T.StructField("touched", T.ArrayType(T.LongType())), T.StructField("queries", T.ArrayType(T.StringType()))]
_OUT = T.StructType([T.StructField("scope", T.StringType()), *_LISTS, T.StructField("open", T.BooleanType())])


@dataclass
class Carried:
    """The ``CARRIED`` latest things and queries, the latest first, each once."""

    touched: list[int] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)

    def take(self, artifact_id: int | None, query: str | None) -> None:
        if artifact_id is not None:
            self.touched = [artifact_id, *(x for x in self.touched if x != artifact_id)][:CARRIED]
        query = (query or "").strip()
        newest = self.queries[0] if self.queries else ""
        if not query or newest.startswith(query):
            return  # nothing, or typing went back: the longer one was meant
        older = self.queries[1:] if newest and query.startswith(newest) else self.queries
        self.queries = [query, *(x for x in older if x != query)][:CARRIED]


def _value(x):
    return None if pd.isna(x) else x


def carried(events: DataFrame, idle: int) -> DataFrame:
    """(scope, session, last_at, touched, queries) of every sitting of a table. Events pass a task in their order, which holds one sitting's lists at a time."""
    by = ["scope", "session", "at", "id"]
    rows = sessions(events, idle).select(*by, "artifact_id", "query")
    kinds = [rows.schema["scope"], rows.schema["session"], *_LISTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, last = None, Carried(), 0
        for batch in batches:
            out = []
            for scope, session, at, _, artifact, query in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (scope, session):
                    out += [(*key, last, held.touched, held.queries)] if key else []
                    key, held = (scope, session), Carried()
                held.take(artifact, query)
                last = at
            yield _rows(out, shape)
        yield _rows([(*key, last, held.touched, held.queries)] if key else [], shape)

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(T.StructType(kinds))
    return rows.repartition("scope", "session").sortWithinPartitions(*by).mapInArrow(run, T.StructType(kinds))


def _rows(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(shape)], schema=shape)


class _Sittings(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("carried", T.StructType(_LISTS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, held, out = None, Carried(), []
        if self.state.exists():
            last, touched, queries = self.state.get()
            held = Carried([int(x) for x in touched], [str(x) for x in queries])
        for at, _, artifact, query in pd.concat(list(rows)).sort_values(["at", "id"])[["at", "id", "artifact_id", "query"]].itertuples(index=False):
            if last is not None and at - last > self.idle:
                out.append((key[0], last, held.touched, held.queries, False))
                held = Carried()
            artifact, query = _value(artifact), _value(query)
            held.take(None if artifact is None else int(artifact), query)
            last = int(at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # an event of the last allowed second still goes on with the sitting
        self.handle.registerTimer((last + self.idle + 1) * 1000)
        self.state.update((last, held.touched, held.queries))
        out.append((key[0], last, held.touched, held.queries, True))
        yield pd.DataFrame(out, columns=["scope", "last_at", "touched", "queries", "open"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last, touched, queries = self.state.get()
            self.state.clear()
            yield pd.DataFrame([(key[0], last, list(touched), list(queries), False)], columns=["scope", "last_at", "touched", "queries", "open"])

    def close(self) -> None:
        pass


def stream_sittings(events: DataFrame, idle: int, late: str = "10 seconds") -> DataFrame:
    """(scope, last_at, touched, queries, open) as events come: after each batch what a sitting carries, and once more when it ends, with ``open`` false.

    State is one value a scope, of ``CARRIED`` entries a list; a timer takes it away when the watermark has passed the sitting. Scopes as text. Needs the RocksDB state store.
    """
    timed = events.withColumn("scope", F.col("scope").cast("string")).withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    narrow = timed.select("scope", "id", "at", F.col("artifact_id").cast("long").alias("artifact_id"), "query", "ts")
    return narrow.groupBy("scope").transformWithStateInPandas(_Sittings(idle), _OUT, "Update", "EventTime")
