"""Vectors packed into tiles, and a two-dimensional grid in which tiles meet.

A tile is one row: up to some thousand ids and their vectors as bytes. Every asked tile meets every held one
as a joined row, and a task compares the two as matrices. Asked tiles are cut into H blocks and held ones into G groups; the join is on the
cell (g, h). While all asked tiles together are within ``BLOCK_BYTES`` they are one block, which Spark broadcasts; beyond that both
sides are shuffled by cell. So nothing passes through the driver but a block of checked size, and no task holds more than its cell's
tiles one by one, and the best of one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of asked tiles that are broadcast, or go to a cell.
BLOCK_BYTES = 32 << 20
#: Of held tiles that one task takes beside a block.
GROUP_BYTES = 16 << 20
#: Joined rows are taken in Arrow batches; a tile's vectors are kept to so many bytes, so that a batch stays small.
TILE_BYTES = 1 << 20


def pack(rows: DataFrame, cut: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """A table of tiles: ``cut`` makes the tiles of a batch, each a row of ``schema``; ``tile`` numbers them (write the table before it is read twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in cut(batch):
                yield pa.RecordBatch.from_pylist([tile], schema=wanted)

    wanted = arrow_schema(schema)
    return rows.mapInArrow(run, schema).withColumn("tile", F.monotonically_increasing_id())


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def meet(asked: DataFrame, held: DataFrame, most: int = BLOCK_BYTES, *, write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every tile of ``asked`` (columns a_*) beside every tile of ``held`` (columns c_*), with ``cell``, by which rows lie together.

    Both are tables of ``pack`` with their bytes in ``bytes``; ``asked`` has been written. ``held`` too, or ``write`` does it if the grid needs it twice or deals it anew. No pair is left out.
    A task has one block and ``GROUP_BYTES`` of held tiles, so its time does not grow with the tables; their product is in the number of tasks.
    """
    total = lambda t: t.agg(F.sum("bytes")).first()[0] or 0
    size = total(asked)
    h, g = max(1, -(-size // most)), 1
    # few asked rows are a pass over the held tiles where they lie
    if size > TILE_BYTES:
        held = write(held) if write else held
        sized = held.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
        groups = -(-(sized.b or 0) // min(most, GROUP_BYTES))
        parts = max(1, groups, min(sized.n, -(-4 * asked.sparkSession.sparkContext.defaultParallelism // h)))
        if h > 1:
            g = parts
        else:
            held = held.repartition(parts, "tile")
    place = lambda n, seed: F.pmod(F.xxhash64("tile", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = asked.withColumn("h", place(h, 5)).withColumn("g", every(g) if g > 1 else place(1, 7))
    two = held.withColumn("g", place(g, 7)).withColumn("h", every(h) if h > 1 else place(1, 5))
    one = one.select("g", "h", *[F.col(c).alias(f"a_{c}") for c in asked.columns])
    two = two.select("g", "h", *[F.col(c).alias(f"c_{c}") for c in held.columns])
    if h > 1:
        # by number, as cells are much work for few bytes and are not to be put together again
        one, two = (t.repartition(2 * g * h, "g", "h") for t in (one, two))
    met = two.join(F.broadcast(one) if h == 1 else one, ["g", "h"])
    return met.withColumn("cell", F.col("g") * h + F.col("h")).drop("g", "h")


def rows_of(blob: pa.Scalar, dim: int, kind: str = "<f8") -> np.ndarray:
    """The matrix that a tile's bytes are."""
    found = np.frombuffer(blob.as_buffer(), kind)
    return found.reshape(-1, dim) if dim else found.reshape(0, 0)
