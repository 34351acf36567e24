import numpy as np
import pytest

from lawspark.operators import profile


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(1)
    return ["x " * int(n) for n in r.integers(1, 60, 200)] + ["", "đ ư\n"]


def _df(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_lengths_and_summary(spark, texts):
    rows = profile.lengths(_df(spark, texts)).collect()
    assert all((r.n_chars, r.n_words) == (len(r.text), len(r.text.split())) for r in rows)
    s = profile.length_summary(_df(spark, texts)).first()
    n = [len(t) for t in texts]
    assert (s.n_chunks, s.max_chars, s.min_chars) == (len(n), max(n), min(n))
    assert s.avg_chars == pytest.approx(np.mean(n)) and s.median_chars == np.median(n)
    assert profile.length_summary(_df(spark, texts[:0])).count() == 0


@pytest.mark.parametrize("pick", [slice(None), slice(0, 1)])  # one text: equal lengths
def test_histogram(spark, texts, pick):
    got = profile.length_histogram(_df(spark, texts[pick])).where("measure = 'chars'").orderBy("bin").collect()
    n, edges = np.histogram([len(t) for t in texts[pick]], bins=30)
    assert [r.n for r in got] == list(n)
    assert [r.lo for r in got] + [got[-1].hi] == pytest.approx(list(edges))


def test_density(spark, texts):
    n = np.array([len(t) for t in texts], dtype=float)
    for bandwidth in (None, 3.0):
        h = bandwidth or len(n) ** -0.2 * n.std(ddof=1)
        rows = profile.length_density(_df(spark, texts), grid_size=20, bandwidth=bandwidth).where(
            "measure = 'chars'").orderBy("grid").collect()
        x = np.linspace(n.min(), n.max(), 20)
        want = np.exp(-0.5 * ((x[:, None] - n) / h) ** 2).sum(1) / (len(n) * h * np.sqrt(2 * np.pi))
        assert [r.density for r in rows] == pytest.approx(list(want))
    assert profile.length_density(_df(spark, texts[:1])).count() == 0
