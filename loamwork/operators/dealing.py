"""How many tasks share the rows of a sort or a grouping.

The session's number of shuffle partitions stands still while tables grow, and what a task sorts or groups would grow with them. Here the
number follows the rows; as it is stated, partitions are not put together again either.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of rows that one task sorts or groups, about.
TASK_ROWS = 250_000
#: Of texts, and of their characters as bytes, whose Python objects a worker holds at once.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20
#: Up to so many narrow rows are sent to every task.
FEW = 1_000_000


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: ``TASK_ROWS`` in each, fewer while cores would idle."""
    return max(1, -(-rows // TASK_ROWS), min(spark.sparkContext.defaultParallelism, rows // 4096))


def bucket(parts: int, *keys: str) -> Column:
    """A number by which keys are dealt to ``parts`` partitions; there are many more than partitions, so that these are even."""
    return F.pmod(F.xxhash64(*keys), F.lit(16 * parts)).cast("int")


def beside(rows: DataFrame, other: DataFrame, on: str, parts: int | None) -> DataFrame:
    """Left join of a long table with one of narrow rows. With ``parts``, few are sent to every task, and with more both are dealt by the key."""
    if not parts:
        return rows.join(other, on, "left")
    if other.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(other), on, "left")
    return rows.repartition(parts, on).join(other.repartition(parts, on), on, "left")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``rows``, fewer where they are long on average: what is made of a batch at once stays as small, however many rows Spark sends together."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
