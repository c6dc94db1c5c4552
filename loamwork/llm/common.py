"""What several operators of this subpackage share.

Words are runs of anything but the six white-space bytes of ``WS``; lower-casing
touches A-Z only. Both rules are the same in Spark, Python and DuckDB.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.storage import materialise as materialise

WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def ascii_lower_text(text: str) -> str:
    """A-Z lowered; the way over bytes beats a translation of every character."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text; null has none."""
    return _WORD.findall(ascii_lower_text(text)) if text else []


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8. Bytes split at just the six bytes of ``WS``, and lower A-Z alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back to the system what its task has freed: it lives on, and other tasks' memory comes on top."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


#: Bytes of texts that a Python worker gets at once, where the session has no smaller bound: both sides hold several copies of a batch.
BATCH_BYTES = 8 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """The same table; its session hands out batches of ``BATCH_BYTES`` at most from now on, so long texts make small batches."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = conf.get(name, None)
    if given and given.rstrip("b").isdigit() and int(given.rstrip("b")) > BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return docs


def buckets(entries: DataFrame, most: int = 1_000_000) -> int:
    """Into how many partitions to deal a written table so that each gets about ``most`` rows or fewer."""
    return max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
