"""Dense and sparse search, fusion and reranking against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawspark.operators import dense, lexical, search

DIM = 6


def _vectors(n, seed):
    r = random.Random(seed)
    return [(i, [float(r.randint(-3, 3)) for _ in range(DIM)]) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    items = _vectors(120, 1) + [(i + 500, v) for i, v in _vectors(30, 1)]  # copies tie
    queries = _vectors(9, 2)
    schema = "id bigint, v array<float>"
    return items, queries, spark.createDataFrame(items, schema), spark.createDataFrame(queries, schema)


def _score(metric, a, b):
    a, b = np.array(a), np.array(b)
    if metric == "cosine":
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else 0.0
    if metric == "dot":
        return float(a @ b)
    return float(np.abs(a - b).sum()) if metric == "manhattan" else float(np.linalg.norm(a - b))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid", "manhattan"])
@pytest.mark.parametrize("limits", [{}, {"max_bytes": 300}])
def test_nearest(tables, metric, limits):
    items, queries, i_df, q_df = tables
    got = {}
    for r in dense.nearest(i_df, q_df, 5, metric, **limits).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 6)))
    sign = 1 if metric in ("euclid", "manhattan") else -1
    for q, qv in queries:
        ranked = sorted((sign * round(_score(metric, v, qv), 6), i) for i, v in items)[:5]
        want = [(n, i, sign * s) for n, (s, i) in enumerate(ranked, 1)]
        assert sorted(got[q]) == want


def test_threshold_and_missing_vectors(spark, tables):
    _, _, i_df, q_df = tables
    all_rows = dense.nearest(i_df, q_df, 1000).where("score >= 0.4").count()
    assert dense.nearest(i_df, q_df, 1000, threshold=0.4).count() == all_rows
    far = dense.nearest(i_df, q_df, 1000, "euclid").where("score <= 3").count()
    assert dense.nearest(i_df, q_df, 1000, "euclid", threshold=3.0).count() == far
    none = spark.createDataFrame([(1, None), (2, [])], "id bigint, v array<float>")
    assert dense.nearest(i_df, none).count() == 0
    assert dense.nearest(none.unionByName(i_df), q_df, 3).where("id < 3 AND rank = 1").count() == \
        dense.nearest(i_df, q_df, 3).where("id < 3 AND rank = 1").count()


def test_unknown_distance(tables):
    with pytest.raises(ValueError):
        dense.nearest(tables[2], tables[3], distance="hamming")


def test_normalise_and_embed(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r.n for r in df.select(dense.l2_normalise(F.col("v")).alias("n")).collect()]
    assert got == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]

    def open_model():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    rows = [r.e for r in texts.select(dense.embed(F.col("t"), open_model, batch_size=2).alias("e")).collect()]
    assert rows == [pytest.approx([3 / 10**0.5, 1 / 10**0.5]), [0.0, 1.0], [0.0, 1.0]]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(80)]
    docs += [(i + 200, t) for i, t in docs[:20]]
    queries = [(i, " ".join(r.choice([*words, "new"]) for _ in range(6))) for i in range(7)] + [(99, "new")]
    schema = "id bigint, text string"
    return docs, spark.createDataFrame(docs, schema), spark.createDataFrame(queries, schema)


def _sparse_truth(docs_df, queries_df, model, k):
    v = lambda df: {r.id: dict(zip(r.indices, r["values"])) for r in
                    lexical.sparse_vectors(df, model, "id").collect()}
    d, q = v(docs_df), v(queries_df)
    out = set()
    for qid, qv in q.items():
        s = [(-round(sum(w * dv.get(t, 0) for t, w in qv.items()), 6), i) for i, dv in d.items()
             if set(qv) & set(dv)]
        out |= {(qid, i, n, -x) for n, (x, i) in enumerate(sorted(s)[:k], 1)}
    return out


@pytest.mark.parametrize("limits", [{}, {"max_bytes": 300}])
def test_sparse_search_over_stored_vectors_and_over_texts(corpus, limits):
    _, docs, queries = corpus
    model = lexical.with_term_ids(lexical.fit(docs))
    want = _sparse_truth(docs, queries, model, 6)
    stored = search.sparse_search(
        lexical.sparse_vectors(docs, model, "id"), lexical.sparse_vectors(queries, model, "id"), 6, **limits
    )
    texts = search.sparse_search(*lexical.search_vectors(docs, queries, model, "id", "id"), 6, **limits)
    for found in (stored, texts):
        assert {(r.query_id, r.id, r["rank"], round(r.score, 6)) for r in found.collect()} == want


def test_search_over_texts_shuffles_only_candidates(corpus):
    _, docs, queries = corpus
    model = lexical.fit(docs, only_terms=lexical.query_terms(queries))
    found = search.sparse_search(*lexical.search_vectors(docs, queries, model, "id", "id"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan and "Cartesian" not in plan


def _list(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, id bigint, score double, rank bigint")


def test_rrf(spark):
    d = _list(spark, [(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 10, 0.5, 1)])
    s = _list(spark, [(1, 11, 7.0, 1), (1, 12, 6.0, 2)])
    rows = search.rrf(d, s, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r["rank"]) for r in rows] == [(1, 11, 1), (1, 10, 2), (2, 10, 1)]
    assert rows[0].total_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)
    assert (rows[0].dense_score, rows[0].sparse_score) == (0.8, 7.0)
    assert rows[1].sparse_score is None


def test_hybrid_needs_a_vector_and_falls_back(spark, tables, corpus):
    _, _, i_df, q_df = tables
    _, docs, queries = corpus
    model = lexical.fit(docs)
    items, sq = lexical.search_vectors(docs, queries, model, "id", "id")
    q = q_df.where("id < 3").unionByName(spark.createDataFrame([(4, None)], "id bigint, v array<float>"))
    rows = search.hybrid_search(i_df, q, items, sq).collect()
    assert {r.query_id for r in rows} == {0, 1, 2}
    assert max(r["rank"] for r in rows) == 7
    alone = search.hybrid_search(i_df, q, None).collect()
    assert all(r.total_score == r.dense_score >= 0.4 and r.sparse_score == 0 for r in alone)


def test_rerank(spark):
    assert search.candidate_limit(False) == 7 and search.candidate_limit(True) == 20
    c = spark.createDataFrame(
        [(1, i, 0.1, i, t) for i, t in enumerate(["a", "bb", "cc", "d"], 1)],
        "query_id bigint, id bigint, total_score double, rank bigint, text string",
    )
    assert [r.id for r in search.rerank(c, 2).orderBy("rank").collect()] == [1, 2]

    def open_model():
        return lambda pairs: [len(t) for _, t in pairs]

    scored = c.withColumn("s", search.cross_encode(F.lit("q"), F.col("text"), open_model))
    rows = search.rerank(scored, 3, "s").orderBy("rank").collect()
    assert [(r.id, r.total_score, r["rank"]) for r in rows] == [(2, 2.0, 1), (3, 2.0, 2), (1, 1.0, 3)]


def test_vectors_that_are_no_numbers_lose_nothing(spark):
    rows = [(i, [float(i), 1.0]) for i in range(10)] + [(90, [float("nan"), 1.0]), (91, [float("nan"), 0.0])]
    items = spark.createDataFrame(rows, "id bigint, v array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "q bigint, v array<float>")
    for metric in ("dot", "cosine", "euclid"):
        got = dense.nearest(items, queries, 3, metric).collect()
        assert len(got) == 3 and all(r.id < 90 for r in got)


def test_vectors_of_mixed_sizes_are_named(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0, 4.0])], "id bigint, v array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "q bigint, v array<float>")
    with pytest.raises(Exception, match="different sizes|vectors of size"):
        dense.nearest(items.coalesce(1), queries).collect()


def test_stored_postings_search_as_texts_do(spark):
    docs = spark.createDataFrame([(i, f"common w{i % 5} w{i % 3} x{i}") for i in range(40)], "id bigint, text string")
    queries = spark.createDataFrame([(1, "common w1"), (2, "x7 x9 nothing"), (3, "")], "q bigint, text string")
    model = lexical.fit(docs)
    stored = search.postings(docs, model, "id", "postings_test")
    got = search.postings_search(stored, queries, model, "q", 5).select("query_id", "id", "rank").collect()
    want = search.sparse_search(*lexical.search_vectors(docs, queries, model, "id", "q"), k=5)
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("query_id", "id", "rank").collect()))
    spark.sql("DROP TABLE postings_test")


def test_stored_search_brings_a_text_together_once(spark, monkeypatch):
    """All texts share a word with all queries: lists of texts are scored, not rows of pairs."""
    docs = spark.createDataFrame([(i, f"chung rieng{i}") for i in range(40)], "id long, text string")
    queries = spark.createDataFrame([(q, f"chung rieng{q}") for q in range(30)], "qid long, text string")
    model = lexical.fit(docs)
    stored = lexical.weights(docs, model, "id").select("term", "id", "weight")
    plain, scored = search.sparse_search, []

    def counted(items, *args, **kwargs):
        scored.append(items.count())
        return plain(items, *args, **kwargs)

    monkeypatch.setattr(search, "sparse_search", counted)
    found = search.postings_search(stored, queries, model, "qid", k=1)
    assert [(r.query_id, r.id) for r in found.orderBy("query_id").collect()] == [(q, q) for q in range(30)]
    assert scored == [40]
