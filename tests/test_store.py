"""A saved graph is read back as it was; a folder that wasn't saved to the end, or was changed, is told apart."""

import shutil

import pytest

from codeloom.sources import store


def test_store(spark, tmp_path):
    at = str(tmp_path / "graph")
    nodes = spark.createDataFrame([("a", None, ["x"]), ("b", 2, None), ("b", 2, None)], "id string, ord int, names array<string>")
    edges = spark.createDataFrame([], "src string, dst string")
    tables = {"nodes": nodes, "edges": edges}
    with pytest.raises(FileNotFoundError):
        store.load(spark, at, "nodes")
    assert store.changed(spark, at) == []
    assert store.save(at, tables) and not store.save(at, tables) and store.save(at, tables, force=True)
    found = store.load(spark, at, "nodes", "edges")
    assert sorted(map(str, found["nodes"].collect())) == sorted(map(str, nodes.collect()))
    assert found["edges"].count() == 0 and found["edges"].dtypes == edges.dtypes
    assert not store.is_complete(spark, at, ["nodes", "embeddings"]) and store.changed(spark, at) == []
    nodes.limit(2).write.mode("overwrite").parquet(f"{at}/nodes.parquet")
    shutil.rmtree(f"{at}/edges.parquet")
    assert store.changed(spark, at) == ["edges", "nodes"]
