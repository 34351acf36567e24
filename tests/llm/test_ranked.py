"""Ranked search against plain Python: ties, copies, long texts, repeated and null ids."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lawspark.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(_LOW))


def brute(docs, items, k=10):
    have = [(d, Counter(terms(t))) for d, t in docs]
    have = [(d, c, sum(c.values())) for d, c in have if c]
    n_docs, words = len(have), sum(n for _, _, n in have)
    df = Counter(t for _, c, _ in have for t in c)
    out = []
    for item, text in sorted(set((i, t or "") for i, t in items), key=str):
        asked, scored = Counter(terms(text)), []
        for d, c, n in have:
            m = 100 - 75 + (75 * n * n_docs) // words
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, q in asked.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(map(str, out))


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted(str(tuple(r)) for r in ranked.search(ranked.index(d), q, **kw).collect())


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    zipf = 1 / np.arange(1, 401)
    out = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=zipf / zipf.sum()))) for i in range(300)]
    out += [(1000 + i, "W7 w9, w200 w7-w7") for i in range(40)]  # copies, in order of id
    out += [(400 - i, "w7 w9 w200 w7 w7") for i in range(15)]  # other texts of the same score
    out += [(None, None), (2000, ""), (2001, " ,;\n"), (2002, "w5 " * 40_000 + "needle"), (None, "needle é É ß 字"), (2003, "needle"),
            (5, "w1 w3 two texts of one id"), (5, "w1 w3 two texts of one id"), (2004, "[@`{/:w9")]
    return out


@pytest.fixture(scope="module")
def items(docs):
    out = [(i, docs[7 * i][1]) for i in range(40)]
    return out + [(50, "w7 w9 w9"), (51, None), (52, ""), (53, "unheard of"), (54, "NEEDLE é"), (55, "É"), (56, "w5 w5 w5"), (None, "w3 w1"),
                  (57, "w1"), (57, "w1"), (57, "w2 needle"), (58, "two texts of one id")]


def test_equals_plain_python(spark, docs, items):
    assert found(spark, docs, items) == brute(docs, items)


def test_small_blocks(spark, docs, items, monkeypatch):
    """Many blocks of documents and of queries, and signatures so short that most bits are set."""
    for name, value in (("BLOCK", 16), ("BLOCK_BYTES", 1600), ("SLICE", 4000), ("BITS", 1)):
        monkeypatch.setattr(ranked, name, value)
    assert found(spark, docs, items, k=3, query_bytes=3000) == brute(docs, items, 3)


def test_no_rows(spark, docs):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_bounds_are_never_below_the_score(docs, items):
    """The signature of a block bounds each document's exact score from above, and rules most out."""
    import pyarrow as pa
    from dataclasses import replace

    table = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    rows = sorted((i, t) for i, t in enumerate(t or "" for _, t in items))
    asked = ranked._asked(pa.table({"item": [i for i, _ in rows], "text": [t for _, t in rows]}))
    have = [c for c in (Counter(terms(t)) for _, t in docs) if c]
    n_docs, words = len(have), sum(sum(c.values()) for c in have)
    df = Counter(t for c in have for t in c)
    names = [bytes(asked.data[s : s + n]).decode() for s, n in zip(asked.start, asked.size, strict=True)]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in names])
    asked = replace(asked, weight=weight, docs=n_docs, words=words)
    above = total = 0
    for b in ranked._index(iter([table])):
        lists = [b.column(c)[0].as_py() for c in ("lengths", "peaks", "slices", "texts")]
        ub = ranked.bounds(lists[2], b.column("bits")[0].as_py(), np.array(lists[0]), np.array(lists[1]), asked)
        for col, text in enumerate(lists[3]):
            c = Counter(terms(text))
            for r, (_, query) in enumerate(rows):
                tf = np.array([c[t] for t in terms(query)], np.int64)
                exact = 0
                if len(tf):
                    value = ranked.share(tf, np.full(len(tf), sum(c.values())), n_docs, words)
                    exact = int((value * weight[[names.index(t) for t in terms(query)]]).sum())
                assert ub[r, col] >= exact
                above, total = above + (ub[r, col] > 2 * exact + 1000), total + 1
    assert above < total / 4
