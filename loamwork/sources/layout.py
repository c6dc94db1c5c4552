"""Tables laid out by the columns that are filtered and replaced most.

What a vector store indexes by keys is here a matter of where rows lie: status and kind are folders, which a filter prunes before
anything is read, and rows within are sorted by a column whose smallest and largest value each row group knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_laid_out(rows: DataFrame, folder: str, by: list[str], cluster: str, rows_a_file: int = 2_000_000) -> None:
    """Writes a table into folders of ``by``, sorted within by ``cluster``. A folder of many rows is dealt by ranges of it over several tasks, so a hot value is no task's whole work."""
    spread = rows.repartitionByRange(*by, cluster) if len(by) else rows.repartitionByRange(cluster)
    spread.sortWithinPartitions(*by, cluster).write.partitionBy(*by).option("maxRecordsPerFile", rows_a_file).mode("overwrite").parquet(folder)


def replace_partitions(rows: DataFrame, folder: str, by: list[str]) -> None:
    """Puts these rows in place of those folders that they have rows for, and touches no other."""
    rows.repartition(*by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def append_log(events: DataFrame, folder: str, at: str = "at", seconds: int = 86400) -> None:
    """Appends to a log in folders of a day each."""
    events.withColumn("day", F.floor(F.col(at) / seconds)).write.partitionBy("day").mode("append").parquet(folder)


def log_window(spark: SparkSession, folder: str, start: int, end: int, at: str = "at", seconds: int = 86400) -> DataFrame:
    """Events of a log from ``start`` up to before ``end``; only the days between are read."""
    days = F.col("day").between(start // seconds, (end - 1) // seconds)
    return spark.read.parquet(folder).where(days & (F.col(at) >= start) & (F.col(at) < end)).drop("day")
