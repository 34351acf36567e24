"""The pipeline's stages, each against plain Python on its own input."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402
from llm import brute  # noqa: E402
from llm.test_contracts import TEXTS, check_pieces  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(d if d is None else d + 10**6, t, "en", "odd", None) for d, t in TEXTS], given.schema
    )
    return given.unionByName(odd)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]


def test_quality_keeps_clean_documents(spark, docs):
    out = P.quality_filter(spark, docs, SF)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    out = P.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    given = pairs(docs)
    want = {p for p, (_, least) in zip(given, brute.near_duplicates(given, 5), strict=True) if p[0] == least}
    # Texts without words are no copies of each other.
    want |= {p for p in given if not (p[1] or "").strip(" \t\n")}
    got = pairs(out)
    assert len(got) == len(set(got)) and set(got) == want


def test_decontamination(spark, docs):
    out = P.decontamination(spark, docs, SF)
    assert out.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    given = pairs(docs)
    want = [p for p, r in zip(given, brute.decontaminate(given, items), strict=True) if not r[-1]]
    assert sorted(map(str, pairs(out))) == sorted(map(str, want))


def test_personal_data_goes_and_all_documents_stay(spark, docs):
    out = P.personal_data(spark, docs, SF)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r.doc_id: r for r in out.where("source <> 'odd'").collect()}
    for d, t in pairs(docs.where("source <> 'odd'")):
        assert not brute.pii_base(got[d].text) and got[d].n_chars == len(got[d].text)
        if not brute.pii_base(t):
            assert got[d].text == t
    assert out.count() == docs.count()


def test_packing(spark, docs):
    assert check_pieces(P.pack(spark, docs, SF).collect(), pairs(docs)) > 0.95


def test_empty_documents(spark, docs):
    none = docs.where(F.lit(False))
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run(spark):
    rows = P.run(spark, SF).collect()
    ids = {r.doc_id for r in rows}
    given = pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    assert 0.5 * len(given) < len(ids) < len(given)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
