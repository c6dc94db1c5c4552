"""Generations of a table: written whole beside the one that is read, then taken over by one rename.

A folder holds ``g1``, ``g2`` and so on, each a table, and the pointer ``current`` with the number of the one to read. A generation is whole
once its manifest is there, which is written after its rows; the pointer is swapped by a rename, so a reader sees the old one or the new one and
nothing in between. Readers name the generation they began with. Old generations stay until someone drops them: they are the way back.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.functions.text import sparse_vector


class Generations:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self._conf)

    def _read_text(self, name: str) -> str | None:
        files, path = self._files(), self._path(name)
        if not files.exists(path):
            return None
        source = files.open(path)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def _write_text(self, name: str, text: str) -> None:
        """Beside the place first, then there by one rename that replaces what is there."""
        beside, jvm = self._path(f".{name.replace('/', '-')}.new"), self._jvm
        sink = self._files().create(beside, True)
        sink.write(bytearray(text.encode()))
        sink.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self._conf)
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, self._path(name), rename)

    def numbers(self, whole: bool = True) -> list[int]:
        """Generations there are, in order; those without a manifest only if asked for."""
        files = self._files()
        if not files.exists(self._jvm.org.apache.hadoop.fs.Path(self.folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.folder))]
        found = sorted(int(n[1:]) for n in names if n[0] == "g" and n[1:].isdigit())
        return [n for n in found if not whole or self.manifest(n) is not None]

    def manifest(self, number: int) -> dict | None:
        text = self._read_text(f"g{number}/_manifest.json")
        return json.loads(text) if text else None

    def current(self) -> int | None:
        """The generation that the pointer names; without a pointer, the newest whole one is taken over, as a rebuild must have died before its last step."""
        text = self._read_text("current")
        if text:
            return int(text)
        whole = self.numbers()
        if whole:
            self.point(whole[-1])
        return whole[-1] if whole else None

    def point(self, number: int) -> None:
        """From now on new readers get this generation; an earlier one is the way back."""
        if self.manifest(number) is None:
            raise ValueError(f"generation {number} of {self.folder} isn't whole")
        self._write_text("current", str(number))

    def read(self, number: int | None = None) -> DataFrame:
        """Rows of one generation, the current one unless named; later swaps don't change what was read."""
        number = self.current() if number is None else number
        if number is None or self.manifest(number) is None:
            raise ValueError(f"no whole generation {number or ''} in {self.folder}")
        return self.spark.read.schema(self.manifest(number)["schema"]).parquet(f"{self.folder}/g{number}")

    def write(self, rows: DataFrame, number: int | None = None, **facts) -> int:
        """A new generation, whole but not yet current; ``facts`` go into its manifest. What an unfinished one left under its number, the next one unless given, is overwritten."""
        number = number or max(self.numbers(), default=0) + 1
        path = f"{self.folder}/g{number}"
        rows.write.mode("overwrite").parquet(path)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self._write_text(f"g{number}/_manifest.json", json.dumps({"schema": kinds, "rows": self.spark.read.schema(kinds).parquet(path).count(), **facts}))
        return number

    def publish(self, rows: DataFrame, **facts) -> int:
        number = self.write(rows, **facts)
        self.point(number)
        return number

    def drop(self, number: int) -> None:
        if number == self.current():
            raise ValueError("that generation is being read")
        self._files().delete(self._path(f"g{number}"), True)


def reindexed(of: Generations, dim: int, text: Column, vector: str = "vector", sparse: str = "sparse") -> int:
    """A new current generation of the same rows: vectors as they are, sparse terms worked out anew from ``text``. Refuses vectors of another length before it writes anything."""
    rows = of.read()
    other = rows.where(F.col(vector).isNotNull() & (F.size(vector) != dim)).select(F.size(vector).alias("n")).head(1)
    if other:
        raise ValueError(f"vectors have {other[0].n} numbers, not {dim}")
    return of.publish(rows.withColumn(sparse, sparse_vector(text)), dim=dim)
