"""Versions of a collection, checked names, inverted lists."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, retrieval
from tessera.sources import collections as c


def chunks(spark, *rows):
    return spark.createDataFrame(rows, "file_id string, text string")


def test_replace_all_shows_old_or_new(spark, tmp_path):
    path = str(tmp_path / "kb")
    assert c.read_current(spark, path, "policy") is None
    c.replace_all(chunks(spark, ("f1", "a"), ("f2", "b"), ("f2", "  ")), path, "policy")
    old = c.read_current(spark, path, "policy")
    assert old.count() == 2

    broken = chunks(spark, ("f3", "c")).withColumn("text", F.raise_error(F.lit("cut")).cast("string"))
    with pytest.raises(Exception, match="cut"):
        c.replace_all(broken, path, "policy")
    # What a cut write left isn't seen, and goes.
    assert {r.file_id for r in c.read_current(spark, path, "policy").collect()} == {"f1", "f2"}
    assert len(c.recover(spark, path, "policy")) <= 1

    c.replace_all(chunks(spark, ("f9", "z")), path, "policy")
    # A reader that had the old version can still finish.
    assert old.count() == 2 and [r.file_id for r in c.read_current(spark, path, "policy").collect()] == ["f9"]
    assert c.recover(spark, path, "policy") and len([n for n in os.listdir(f"{path}/policy") if n.startswith("version-")]) == 1
    assert c.read_current(spark, path, "policy").count() == 1


@pytest.mark.parametrize("name", ["..", ".", "a/b", "../x", "", "x\n"])
def test_names_don_t_lead_elsewhere(spark, tmp_path, name):
    for call in (lambda: c.remove(spark, str(tmp_path), name), lambda: c.remove(spark, str(tmp_path), "law", name), lambda: c.current(spark, str(tmp_path), name)):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_lists_find_nine_of_ten(spark, tmp_path, sf):
    v = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").selectExpr("vec_id AS id", "label AS file_id", "embedding")
    q = v.where("id % 20 = 0").selectExpr("id AS query_id", "embedding")
    centroids = index.build(v, str(tmp_path / "lists"))
    found = index.probed(q, str(tmp_path / "lists"), centroids, 10)
    got = index.recall(found, retrieval.nearest(v, q, 10)).first()
    assert got.recall >= 0.9 and got.queries == q.count() and found.count() == 10 * q.count()
    assert len(centroids) > 8 and index.FEWEST < len(centroids)


def test_empty_index(spark, tmp_path):
    v = spark.createDataFrame([], "id long, embedding array<float>")
    centroids = index.build(v, str(tmp_path / "lists"))
    assert index.probed(v.withColumnRenamed("id", "query_id"), str(tmp_path / "lists"), centroids, 3).collect() == []


def test_long_lists_are_stored_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART", 10)
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS id", "label AS file_id", "embedding")
    centroids = index.build(v, str(tmp_path / "lists"))
    q = v.where("id % 50 = 0").selectExpr("id AS query_id", "embedding")
    assert spark.read.parquet(str(tmp_path / "lists/lists")).where("part > 0").count() > 0
    all_lists = index.probed(q, str(tmp_path / "lists"), centroids, 10, share=1.0)
    exact = retrieval.nearest(v, q, 10).select("query_id", "id", "rank")
    assert sorted(map(tuple, all_lists.select("query_id", "id", "rank").collect())) == sorted(map(tuple, exact.collect()))
