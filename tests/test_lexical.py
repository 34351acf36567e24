"""Spark BM25 against the plain formula."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lawspark.functions import text as tx
from lawspark.operators import lexical
from lawspark.sources.model_store import load_model, save_model

TEXTS = ["a b b c", "B, c/d d", "", "x_y é É a", "b " * 50, "only one gap"]


def tokens(text):
    kept = "".join(c for c in text.lower() if c.isalnum() or c == "_" or c.isspace())
    return kept.split()


class Plain:
    def __init__(self, texts, k1=1.5, b=0.75):
        self.k1, self.b, self.n = k1, b, len(texts)
        toks = [tokens(t) for t in texts]
        self.avg = sum(map(len, toks)) / len(toks)
        self.df = Counter(t for ts in toks for t in set(ts))
        self.idf = {t: math.log((self.n - d + 0.5) / (d + 0.5) + 1) for t, d in self.df.items()}

    def part(self, tf, n):
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * n / self.avg))

    def vector(self, text):
        ts = tokens(text)
        return {t: self.idf[t] * self.part(c, len(ts)) for t, c in Counter(ts).items() if t in self.idf}

    def score(self, query, text):
        ts = tokens(text)
        tf = Counter(ts)
        return sum(self.idf[t] * self.part(tf[t], len(ts)) for t in tokens(query) if t in self.idf and tf[t])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")


@pytest.fixture(scope="module")
def model(docs):
    return lexical.with_term_ids(lexical.fit(docs), partitions=3)


def test_tokens(spark, docs):
    got = [r.t for r in docs.select(tx.tokens(F.col("text")).alias("t"), "id").orderBy("id").collect()]
    assert got == [tokens(t) for t in TEXTS]
    assert got[1] == ["b", "cd", "d"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab Ệđ_-.,\t\n ", max_size=30), min_size=1, max_size=8))
def test_term_counts_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", tx.term_counts(tx.tokens(F.col("text"))).alias("c")).collect()
    for r in got:
        assert {c.term: c.tf for c in r.c} == Counter(tokens(r.text))


def test_statistics(model):
    plain = Plain(TEXTS)
    s = model.stats.first()
    assert (s.doc_count, s.total_len) == (len(TEXTS), sum(len(tokens(t)) for t in TEXTS))
    assert model.avgdl == pytest.approx(plain.avg)
    vocab = {r.term: r for r in model.vocab.collect()}
    assert {t: r.df for t, r in vocab.items()} == plain.df
    assert [vocab[t].term_id for t in sorted(vocab)] == list(range(len(vocab)))
    for t, r in vocab.items():
        assert r.idf == pytest.approx(plain.idf[t])


def test_sparse_vectors(docs, model):
    plain = Plain(TEXTS)
    names = {r.term_id: r.term for r in model.vocab.collect()}
    rows = {r.id: r for r in lexical.sparse_vectors(docs, model, "id").collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert rows[i].indices == sorted(rows[i].indices)
        got = {names[k]: v for k, v in zip(rows[i].indices, rows[i]["values"])}
        assert got == pytest.approx(plain.vector(text))


def test_unknown_terms_count_in_the_length(spark, model):
    q = spark.createDataFrame([(1, "b unknown words here")], "id bigint, text string")
    (v,) = lexical.sparse_vectors(q, model, "id").collect()
    assert v["values"] == pytest.approx([Plain(TEXTS).vector("b unknown words here")["b"]])


def test_pair_scores(spark, model):
    plain = Plain(TEXTS)
    pairs = [("b b c", "b c c z"), ("zzz", "a"), ("a", ""), ("", "a"), ("a a é", "not a in é corpus")]
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(pairs)], "i int, query string, text string")
    got = {r.i: r.score for r in lexical.pair_scores(df, model, ["i"]).collect()}
    assert got == pytest.approx({i: plain.score(q, t) for i, (q, t) in enumerate(pairs)})


def test_only_terms_changes_nothing_for_those_terms(spark, docs, model):
    asked = spark.createDataFrame([("b",), ("nowhere",)], "term string")
    part = lexical.fit(docs, only_terms=asked)
    assert [(r.term, r.df) for r in part.vocab.collect()] == [("b", 3)]
    assert tuple(part.stats.first()) == tuple(model.stats.first())


def test_empty_corpus(spark, docs):
    m = lexical.fit(docs.limit(0))
    assert tuple(m.stats.first()) == (0, 0, 0.0)
    assert m.vocab.count() == 0
    assert lexical.sparse_vectors(docs, lexical.with_term_ids(m), "id").where("size(indices) > 0").count() == 0


def test_save_and_load(spark, docs, model, tmp_path):
    save_model(model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    a = sorted(map(tuple, lexical.weights(docs, model, "id").collect()))
    assert sorted(map(tuple, lexical.weights(docs, again, "id").collect())) == a
    assert load_model(spark, str(tmp_path / "none")) is None


def test_segmenter_is_used(spark, docs):
    def open_segmenter():
        return lambda texts: [t.replace("a b", "a_b") for t in texts]

    terms = {r.term for r in lexical.fit(docs, segmenter=open_segmenter).vocab.collect()}
    assert "a_b" in terms


def test_counts_stand_for_the_texts(spark):
    """Model, vectors and search of a table of counts are those of the texts; repeated and null ids are rows like others."""
    rows = [*enumerate(TEXTS), (1, "b B other"), (None, "É é b\x1cb"), (None, None), (7, " .,; ")]
    texts = spark.createDataFrame(rows, "id bigint, text string")
    counts = lexical.term_counts(texts, "id")
    for r in counts.where("id = 1").collect():
        assert r.doc_len == sum(c.tf for c in r.term_counts)
    plain = sorted((i is None, i or 0, sorted(Counter(tokens(t or "")).items())) for i, t in rows)
    assert sorted((r.id is None, r.id or 0, sorted((c.term, c.tf) for c in r.term_counts)) for r in counts.collect()) == plain
    a, b = lexical.fit(texts), lexical.fit(counts)
    assert tuple(a.stats.first()) == tuple(b.stats.first())
    assert sorted(map(tuple, a.vocab.collect())) == sorted(map(tuple, b.vocab.collect()))

    def vectors(docs, model):
        rows = lexical.sparse_vectors(docs, model, "id", key="term").collect()
        return sorted(map(str, rows))

    assert vectors(texts, a) == vectors(counts, b)
    asked = spark.createDataFrame([(0, "b é gap")], "q bigint, text string")
    one, two = (lexical.search_vectors(d, asked, a, "id", "q")[0] for d in (texts, counts))
    values = lambda df: sorted(str((r.id, sorted(zip(r.indices, r["values"])))) for r in df.collect())
    assert values(one) == values(two)


def test_slices_lose_no_text(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 7)
    b = lexical.pa.record_batch([lexical.pa.array(range(6)), lexical.pa.array(TEXTS)], names=["id", "text"])
    parts = list(lexical._counted([b, b.slice(0, 0)]))
    assert len(parts) > 2
    got = [(r["id"], r["doc_len"]) for p in parts for r in p.to_pylist()]
    assert got == [(i, len(t.split())) for i, t in enumerate(TEXTS)]
