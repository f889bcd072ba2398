"""Fitted pipelines that are stored: versions, a loaded one predicts the same, writers that collide or die."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tessera.sources import models as M
from tessera.sources.stored import list_names


def fitted(spark, slope):
    rows = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") * slope + 1).cast("double").alias("y"))
    return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(rows), rows


def test_a_loaded_model_predicts_the_same_rows(spark, tmp_path):
    store = M.ModelStore(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.load()
    (one, rows), (two, _) = fitted(spark, 2), fitted(spark, 5)
    assert [store.save(one, rows, about="first"), store.save(two, rows)] == [1, 2]
    again = M.ModelStore(spark, str(tmp_path / "store"))
    for version, model in ((1, one), (2, two), (None, two)):
        assert again.predict(rows, version).select("x", "prediction").collect() == model.transform(rows).select("x", "prediction").collect()
    assert again.record(1)["notes"] == {"about": "first"} and again.record()["version"] == 2
    for wrong in (rows.drop("x"), rows.withColumn("x", F.col("x").cast("int"))):
        with pytest.raises(M.WrongSchema, match="x"):
            again.predict(wrong)
    with pytest.raises(LookupError):
        again.load(7)
    again.vacuum(keep=1)
    assert again.versions() == [2] and len([x for x in list_names(spark, again.root) if x.startswith("model-")]) == 1
    assert again.save(one, rows) == 3


def test_the_second_of_two_writers_takes_the_next_number(spark, tmp_path, monkeypatch):
    store, (model, rows) = M.ModelStore(spark, str(tmp_path / "store")), fitted(spark, 2)
    right, other = M.move, []

    def late(spark, source, target):
        if not other:
            other.append(1)
            assert store.save(model, rows) == 1
        right(spark, source, target)

    monkeypatch.setattr(M, "move", late)
    assert store.save(model, rows) == 2 and store.versions() == [1, 2]


def test_a_writer_that_died_leaves_no_version(spark, tmp_path, monkeypatch):
    store, (model, rows) = M.ModelStore(spark, str(tmp_path / "store")), fitted(spark, 2)
    store.save(model, rows)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(M, "move", dies)
        store.save(model, rows)
    assert store.versions() == [1]
    store.vacuum()
    assert sorted(x.split("-")[0] for x in list_names(spark, store.root)) == ["model", "versions"]
