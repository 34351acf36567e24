"""Look-ups against brute force, with null wildcards and caps."""

import random

import pytest
from pyspark.sql import functions as F

from lawspark.operators import citation, citation_index
from lawspark.schemas import CHUNK_POS, REFERENCES
from lawspark.session import scratch_dir

SCHEMA = (
    f"chunk_id string, doc_id bigint, chunk_pos {CHUNK_POS}, article_number bigint, "
    f"clause_number bigint, point string, references {REFERENCES}, text string"
)
REQ = "req_id bigint, document string, article bigint, clause bigint, point string"


def _corpus():
    r = random.Random(5)
    out = []
    for n in range(400):
        doc, art = r.randint(0, 3), r.choice([1, 1, 1, 2, 3, 4])
        refs = [
            (r.choice(["X", "Y"]), r.choice([0, 1, 2, 3, None]), r.choice([None, 1, 2]), r.choice([None, "a"]))
            for _ in range(r.randint(0, 3))
        ]
        out.append((
            f"c{n:03d}", doc, (0, art, n, 0), art, r.choice([0, 1, 2, None]), r.choice(["-1", "a", "đ"]),
            refs, f"t{n}",
        ))
    out.append(("basis", 0, (9, -1, -1, -1), None, None, None, [], "basis"))
    return out


CHUNKS = _corpus()
REQUESTS = [
    (1, "X", 1, None, None), (2, "X", 1, 2, None), (3, "Y", 1, None, "a"), (4, "X", 2, 1, "a"),
    (5, "X", 0, None, None), (6, "X", None, 1, None), (7, "X", 1, 0, None), (8, "X", 1, None, "-1"),
    (9, "X", 77, None, None), (10, "X", 1, None, None), (11, "X", 3, 2, "đ"), (12, None, 2, None, None),
]


def _ordered(rows):
    return sorted(rows, key=lambda c: (c[1], c[2]))


def _at(article, clause, point, cap):
    hits = [c for c in CHUNKS if c[3] == article and clause in (None, c[4]) and point in (None, c[5])]
    return _ordered(hits)[:cap]


def direct(q, cap=50):
    return _at(*q[2:], cap) if q[2] else []


def inbound(q, cap=50):
    def hit(r):
        return r[0] == q[1] and r[1] == q[2] and q[3] in (None, r[2]) and q[4] in (None, r[3])

    return _ordered([c for c in CHUNKS if any(map(hit, c[6]))])[:cap] if q[2] and q[1] else []


def outbound(q, cap=100):
    refs = {}
    for c in direct(q, cap):
        for r in c[6]:
            if r[1]:
                refs.setdefault(r)
    found = {}
    for r in refs:
        for c in _at(r[1], r[2], r[3], cap):
            found.setdefault(c[0], c)
    return list(found.values())


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(REQUESTS, REQ), spark.createDataFrame(CHUNKS, SCHEMA)


def _check(found, truth):
    got = {}
    for r in found.collect():
        got.setdefault(r.req_id, []).append((r["rank"], r.chunk_id, r.text))
    want = {
        q[0]: [(n, c[0], c[7]) for n, c in enumerate(truth(q), 1)] for q in REQUESTS if truth(q)
    }
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("name,truth", [("direct", direct), ("inbound", inbound), ("outbound", outbound)])
def test_lookup(tables, name, truth):
    _check(getattr(citation, f"lookup_{name}")(*tables), truth)


def test_caps(tables):
    _check(citation.lookup_direct(*tables, cap=3), lambda q: direct(q, 3))
    _check(citation.lookup_outbound(*tables, source_cap=5, reference_cap=5), lambda q: outbound(q, 5))


def test_outbound_within_the_document(tables):
    requests, chunks = tables
    rows = citation.lookup_outbound(requests, chunks, same_document=True).where("req_id = 4").collect()
    docs = {c[1] for c in direct(REQUESTS[3], 100) if any(r[1] for r in c[6])}
    assert rows and {r.doc_id for r in rows} <= docs


def test_inbound_and_outbound_are_inverse_for_exact_references(tables):
    requests, chunks = tables
    for r in citation.lookup_inbound(requests.where("req_id = 4"), chunks).collect():
        assert any((x.document, x.article, x.clause, x.point) == ("X", 2, 1, "a") for x in r.references)


def test_plan_has_no_pair_join(tables):
    requests, chunks = tables
    plan = citation.lookup_direct(requests, chunks)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("WindowGroupLimit") == 2


def _exchanges(spark, found):
    """Shuffles of a plan in which no table is small enough to be sent around."""
    off = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(off)
    spark.conf.set(off, "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return found()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(off, before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_listed_rows_move_once(spark, tables, monkeypatch):
    """Keys and listed rows meet and are ranked by one shuffle each, before payload and requests are joined."""
    requests, chunks = tables
    monkeypatch.setattr(citation, "ARTICLES_SENT", 0)
    assert _exchanges(spark, lambda: citation.lookup_inbound(requests, chunks)) == 6
    assert _exchanges(spark, lambda: citation.lookup_direct(requests, chunks)) == 6


def test_many_articles(tables, monkeypatch):
    """Where too many articles are asked to be sent around, the answers are the same."""
    monkeypatch.setattr(citation, "ARTICLES_SENT", 0)
    _check(citation.lookup_direct(*tables), direct)


def test_repeated_and_missing_ids(spark, tables):
    """Each row of an id that comes twice answers for both; one without an id takes a rank and is not found."""
    requests, _ = tables
    row = lambda i, n: (i, 0, (0, 7, n, 0), 7, 1, "a", [], f"t{n}")
    chunks = spark.createDataFrame([row("c", 1), row("c", 1), row(None, 2), row("d", 3)], SCHEMA)
    asked = requests.limit(1).select(F.lit(1).alias("req_id"), F.lit(7).alias("article"), F.lit(None).cast("bigint").alias("clause"), F.lit("a").alias("point"))
    got = sorted((r["rank"], r.text) for r in citation.lookup_direct(asked, chunks).collect())
    assert got == [(1, "t1"), (1, "t1"), (2, "t1"), (2, "t1"), (4, "t3")]


def test_index_lists_hold_no_ids(spark, tables):
    _, chunks = tables
    table = "citations_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
    index = citation_index.build(chunks, table, buckets=4)
    for lists in (index.places, index.cited):
        assert "chunk_id" not in lists.columns
        assert lists.where(F.length(citation_index._REFERENCE) != 16).isEmpty()
    assert index.columns == chunks.columns
    citation_index.drop(spark, table)


def test_scan(tables):
    _, chunks = tables
    got = citation.scan(chunks, F.col("article_number") == 2, 4).collect()
    assert [r.chunk_id for r in got] == [c[0] for c in _at(2, None, None, 4)]
    assert citation.scan(chunks).count() == len(CHUNKS)


@pytest.mark.parametrize("name,truth", [("direct", direct), ("inbound", inbound), ("outbound", outbound)])
def test_lookup_by_index(spark, tables, name, truth):
    requests, chunks = tables
    table = "citations_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
    index = citation_index.build(chunks, table, buckets=4)
    _check(getattr(citation, f"lookup_{name}")(requests, index), truth)
    again = citation_index.load(spark, table)
    _check(citation.lookup_direct(requests, again, cap=3), lambda q: direct(q, 3))
    with pytest.raises(ValueError):
        citation.lookup_direct(requests, again, cap=again.keep + 1)
    citation_index.drop(spark, table)


def test_index_is_read_in_place(spark, tables):
    """Neither the lists nor the chunks are shuffled: no exchange stands above their scans before the join."""
    requests, chunks = tables
    table = "citations_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
    index = citation_index.build(chunks, table, buckets=4)
    off = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(off)
    spark.conf.set(off, "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = index.own(citation._keys(requests.where("article is not null"), ["article", "clause", "point"]), 50, ["text"])
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set(off, before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and table in line]
    assert len(scans) == 2
    for i in scans:
        above = [plan[i - n].strip(" :+-*()0123456789") for n in range(1, 4)]
        assert not any(line.startswith("Exchange") for line in above), plan
    assert sum("Exchange" in line for line in plan) == 2  # keys to the lists, hits to the chunks
