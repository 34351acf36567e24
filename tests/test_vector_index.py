"""The vector index against comparing everything."""

import random

import numpy as np
import pytest

from lawspark.operators import dense, vector_index


def _clustered(n, groups, dim, seed):
    rng = np.random.default_rng(seed)
    centres = 4 * rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = _clustered(3000, 12, 8, 1)
    rows += [(5000 + i, rows[i][1]) for i in range(40)]  # copies tie
    rows += [(6000, None), (6001, []), (6002, [0.0] * 8)]
    r = random.Random(3)
    queries = [(i, v) for i, v in _clustered(20, 12, 8, 1)] + [(50 + i, [r.gauss(0, 3) for _ in range(8)]) for i in range(10)]
    queries += [(80, None), (81, []), (82, rows[5][1]), (83, [0.0] * 8)]
    schema = "id bigint, v array<double>"
    return spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(queries, schema)


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_equals_comparing_everything(tables, tmp_path, monkeypatch, metric):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    monkeypatch.setattr(vector_index, "QUERIES", 5)
    items, queries = tables
    index = vector_index.build(items, str(tmp_path / "index"), metric, cells=16)
    for k, threshold in ((7, None), (3, 0.9 if metric == "cosine" else 1.5), (5000, None)):
        want = dense.nearest(items, queries, k, metric, threshold)
        assert _rows(vector_index.search(index, queries, k, threshold)) == _rows(want)


def test_reads_a_small_share_of_clustered_vectors(spark, tables, tmp_path):
    items, queries = tables
    index = vector_index.build(items, str(tmp_path / "index"), "euclid", cells=16)
    near = queries.where("id < 20")
    assert vector_index.share_read(index, near, 7) < 0.2


def test_small_and_empty(spark, tmp_path):
    schema = "id string, v array<float>"
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], schema)
    q = spark.createDataFrame([("q", [1.0, 2.0]), ("r", None)], schema)
    index = vector_index.build(one, str(tmp_path / "one"))
    assert _rows(vector_index.search(index, q, 3)) == [("q", 1, "a", 1.0)]
    assert _rows(vector_index.search(index, q.where("false"), 3)) == []
    none = vector_index.build(one.where("false"), str(tmp_path / "none"))
    assert _rows(vector_index.search(none, q, 3)) == []
    with pytest.raises(ValueError):
        vector_index.build(one, str(tmp_path / "dot"), "dot")
