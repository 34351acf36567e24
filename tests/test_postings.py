"""Block-max postings against scoring every list in full."""

import random

import pytest

from lawspark.operators import postings, search

SCHEMA = "id bigint, indices array<string>, values array<double>"


def _vectors(n, seed, size):
    """Terms by a steep distribution: ``t0`` stands nearly everywhere with a small weight."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        terms = {f"t{int(r.random() ** 4 * 200)}" for _ in range(r.randint(1, size))} | ({"t0"} if r.random() < 0.9 else set())
        out.append((i, sorted(terms), [round(r.uniform(0.1, 0.4) if t == "t0" else r.uniform(0.5, 6.0), 3) for t in sorted(terms)]))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    items = _vectors(4000, 1, 12) + [(9000 + i, ["t7", "t9"], [2.0, 2.0]) for i in range(30)]  # ties
    items += [(9100, [], []), (9101, None, None), (9102, ["t3", "t4"], [None, -1.0])]
    queries = _vectors(25, 2, 8) + [(100, ["t7", "t9"], [1.0, 1.0]), (101, ["unknown"], [1.0]), (102, [], []), (103, None, None)]
    queries += [(104, ["t0"], [1.0]), (105, ["t0", "t150", "t151"], [1.0, 5.0, 5.0])]
    return spark.createDataFrame(items, SCHEMA).repartition(4), spark.createDataFrame(queries, SCHEMA)


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize(("k", "seeds"), [(7, 60), (1, 200), (100_000, 10)])
def test_equals_full_lists(tables, tmp_path, monkeypatch, k, seeds):
    monkeypatch.setattr(postings, "SEED_POSTINGS", seeds)
    items, queries = tables
    stored = postings.build(items, str(tmp_path / "postings"), block=64, levels=8)
    usable = items.where("id < 9101")  # the plain search takes no null weights
    assert _rows(postings.search(stored, queries, k)) == _rows(search.sparse_search(usable, queries, k))


def test_blocks_are_small_and_of_like_impact(tables, tmp_path):
    stored = postings.build(tables[0], str(tmp_path / "postings"), block=64, levels=8)
    for b in stored.blocks.collect():
        assert len(b.ids) == len(b.weights) == b.n <= 3 * 64
        assert max(b.weights) == b.most


def test_frequent_terms_are_mostly_unread(tables, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "SEED_POSTINGS", 200)
    items, queries = tables
    stored = postings.build(items, str(tmp_path / "postings"), block=64, levels=8)
    share = {r.term: r.share for r in postings.share_read(stored, queries.where("id = 105"), 7).collect()}
    assert share["t0"] < 0.2


def test_empty(spark, tables, tmp_path):
    items, queries = tables
    stored = postings.build(items, str(tmp_path / "a"))
    assert _rows(postings.search(stored, queries.where("false"))) == []
    none = postings.build(items.where("false"), str(tmp_path / "b"))
    assert _rows(postings.search(none, queries)) == []


def test_pairs_of_query_and_id_are_no_rows(spark, tmp_path, monkeypatch):
    """Sixty queries that all ask a term of every text: what is written in between grows with the texts alone."""
    n, sizes = 500, {}
    items = spark.createDataFrame([(i, ["all", f"own{i}"], [1.0 + i / n, 1.0]) for i in range(n)], SCHEMA)
    queries = spark.createDataFrame([(q, ["all", f"own{q}"], [1.0, 0.5]) for q in range(60)], SCHEMA)
    stored = postings.build(items, str(tmp_path / "postings"), block=64, levels=8)

    def written(df, name):
        out = df.localCheckpoint()
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(postings, "written", written)
    found = _rows(postings.search(stored, queries, 3))
    assert len(found) == 180 and found[0][:3] == (0, 1, n - 1)
    assert max(sizes["first"], sizes["able"]) <= n


def test_vectors_of_one_id_add_up(spark, tmp_path):
    items = spark.createDataFrame([(1, ["a"], [1.0]), (1, ["a", "b"], [2.0, 4.0]), (2, ["a"], [2.5]), (None, ["a"], [9.0])], SCHEMA)
    stored = postings.build(items, str(tmp_path / "postings"))
    assert _rows(postings.search(stored, spark.createDataFrame([(7, ["a"], [1.0])], SCHEMA), 2)) == [(7, 1, 1, 3.0), (7, 2, 2, 2.5)]


def test_repeated_terms_are_bounded_by_their_sum(spark, tmp_path, monkeypatch):
    """An id that has a term three times outscores ids whose single postings are larger."""
    monkeypatch.setattr(postings, "SEED_POSTINGS", 1)
    items = [(i, ["a", "b"], [4.0, 4.0]) for i in range(64)] + [(900, ["a"] * 3, [3.0] * 3)]
    stored = postings.build(spark.createDataFrame(items, SCHEMA), str(tmp_path / "postings"), block=8, levels=8)
    queries = spark.createDataFrame([(7, ["a", "b"], [1.0, 1.0])], SCHEMA)
    assert _rows(postings.search(stored, queries, 1)) == [(7, 1, 900, 9.0)]
