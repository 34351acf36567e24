"""Vectors against all pairs: dense groups, copies, unusable vectors, the recall at the threshold."""

import math

import numpy as np
import pytest

from lawspark.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node long"


def brute(rows):
    """Links and components of ``(vec_id, vector)`` rows by all pairs."""
    use = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / max(map(abs, rows[i][1])) for i in use}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    near = {i: [j for j in use if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in use}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near.get(i, [])), least, vec_id == least))
    return sorted(map(str, out))


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], SCHEMA).repartition(3)
    got = vectors.near_vectors(df, **kw)
    return sorted(str(tuple(r)) for r in got.collect())


def around(rng, centre, n, spread):
    return [(centre + spread * rng.normal(size=len(centre))).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=16)
    crowd *= 4 / np.linalg.norm(crowd)
    rows = [(100 + i, v) for i, v in enumerate(around(rng, crowd, 90, 0.12))]  # a third of all, close together
    rows += [(300 + i, v) for i, v in enumerate(around(rng, crowd, 60, 0.45))]  # around it, some linked, some not
    rows += [(500 + i, rng.normal(size=16).tolist()) for i in range(120)]
    rows += [(700 + i, rows[0][1]) for i in range(20)]  # exact copies
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] + [1.0] * 15),
             (905, [float("inf")] + [1.0] * 15), (None, rows[3][1]), (None, [1.0, 2.0, 3.0]), (906, [2.0, 4.0, 6.1]),
             (5, rows[1][1]), (5, rows[200][1]), (907, [x * 1e200 for x in rows[7][1]]), (908, [-x for x in rows[7][1]])]
    return rows


def test_equals_all_pairs(spark, mixed):
    assert found(spark, mixed) == brute(mixed)


def test_small_cells_and_blocks(spark, mixed, monkeypatch):
    """Many cells and several blocks a cell; every cell is visited, so nothing is missed."""
    for name, value in (("CELL", 24), ("BLOCK", 8), ("CHUNK", 3)):
        monkeypatch.setattr(vectors, name, value)
    assert found(spark, mixed, margin=2.0) == brute(mixed)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, [0.0])]) == ["(1, 0, 1, True)", "(2, 0, 2, True)"]


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.93 among random vectors, the hardest to find: at least 0.9 of them are."""
    rng = np.random.default_rng(1)
    n = 3000
    base = rng.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(n, 64))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, size=(n, 1))
    both = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * off])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    links = vectors.near_vectors(df).agg({"n_links": "sum"}).first()[0]
    assert 2 * n * 0.9 <= links <= 2 * n


def test_roots():
    linked = np.zeros((4, 3), bool)
    linked[0, 1] = linked[2, 1] = linked[2, 2] = linked[3, 0] = True
    assert vectors._roots(linked).tolist() == [0, 1, 0, 3, 3, 0, 0]
