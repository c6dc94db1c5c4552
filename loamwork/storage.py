"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_shared: list[str] = []
_deleted_on_exit: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave the setting out; it then gets a temporary
    folder. On a cluster a missing setting is an error, as a folder of one
    machine would lose rows with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_shared:
        _local_shared.append("file://" + tempfile.mkdtemp(prefix="loamwork-"))
    return _local_shared[0]


def _own_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loamwork-{spark.sparkContext.applicationId}"
    if path not in _deleted_on_exit:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _deleted_on_exit.add(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here.

    What follows sees the same rows however often tasks are repeated. The files are there as long as the application,
    as results that are not yet computed read them; ``discard`` frees them before.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` wrote."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if root.split("://")[-1] in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
