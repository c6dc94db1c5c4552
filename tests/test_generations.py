"""Generations of a table, as a rebuild that dies at each of its steps leaves them."""

import os

import pytest
from pyspark.sql import functions as F

from loamwork.functions.text import sparse_vector
from loamwork.sources.generations import Generations, reindexed


@pytest.fixture
def store(spark, tmp_path):
    return Generations(spark, f"file://{tmp_path}/points")


def rows(spark, n, text="a b a"):
    return spark.createDataFrame([(k, [1.0, float(k)], text) for k in range(n)], "id long, vector array<double>, text string")


class Killed(Exception):
    pass


def test_swap_and_pinned_readers(spark, store):
    assert store.current() is None and store.numbers() == []
    with pytest.raises(ValueError):
        store.read()
    assert store.publish(rows(spark, 3)) == 1
    before = store.read()
    assert store.write(rows(spark, 5)) == 2 and store.current() == 1 and store.read().count() == 3
    store.point(2)
    assert (before.count(), store.read().count(), store.read(1).count()) == (3, 5, 3)
    store.point(1)  # the way back
    assert store.read().count() == 3
    with pytest.raises(ValueError):
        store.drop(1)
    store.drop(2)
    assert store.numbers() == [1]


def test_a_rebuild_that_dies(spark, store, monkeypatch, tmp_path):
    store.publish(rows(spark, 3))
    real = Generations._write_text

    def killed_at(name):
        def write(self, to, text):
            if to.endswith(name):
                raise Killed
            real(self, to, text)

        monkeypatch.setattr(Generations, "_write_text", write)
        with pytest.raises(Killed):
            reindexed(store, 2, F.col("text"))
        monkeypatch.setattr(Generations, "_write_text", real)

    killed_at("_manifest.json")  # rows are there, the manifest isn't
    assert os.path.isdir(f"{tmp_path}/points/g2") and store.numbers() == [1] and store.current() == 1 and store.read().columns == ["id", "vector", "text"]
    killed_at("current")  # whole, but between write and swap
    assert store.numbers() == [1, 2] and store.current() == 1 and "sparse" not in store.read().columns
    assert reindexed(store, 2, F.col("text")) == 3 and store.read().count() == 3
    os.remove(f"{tmp_path}/points/current")  # died before there was a pointer: the newest whole one
    os.remove(f"{tmp_path}/points/g3/_manifest.json")
    assert Generations(spark, store.folder).current() == 2 and "sparse" in store.read().columns


def test_reindex_keeps_vectors_and_makes_terms_anew(spark, store):
    store.publish(rows(spark, 2).unionByName(spark.createDataFrame([(9, None, None)], "id long, vector array<double>, text string")))
    with pytest.raises(ValueError):
        reindexed(store, 3, F.col("text"))
    assert store.numbers() == [1]
    reindexed(store, 2, F.col("text"))
    got = {r.id: r for r in store.read().collect()}
    assert got[1].vector == [1.0, 1.0] and got[9].vector is None and got[9].sparse == [] and store.manifest(2)["rows"] == 3
    assert sorted(round(x.weight, 6) for x in got[0].sparse) == [round(2.2 / 2.2, 6), round(2 * 2.2 / 3.2, 6)]


def test_sparse_vectors_of_long_texts(spark):
    text = " ".join(f"w{k % 700}" for k in range(20_000))
    (found,) = spark.createDataFrame([(text,)], "t string").select(sparse_vector(F.col("t")).alias("s")).first()
    assert len(found) == 700 and [x.term for x in found] == sorted(x.term for x in found)
    n = sorted(20_000 // 700 + (k < 20_000 % 700) for k in range(700))
    assert sorted(x.weight for x in found) == pytest.approx([k * 2.2 / (k + 1.2) for k in n])
