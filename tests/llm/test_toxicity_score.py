"""Small chances add up to the document's score."""

import numpy as np
import pyarrow as pa
import pytest

from lawspark.llm import text as T
from lawspark.llm import toxicity


def test_diffuse_evidence_counts(spark):
    data, offsets = T.utf8(pa.array(["vile"]))
    w = np.zeros(1 << toxicity.BITS)
    w[toxicity._features(T.words(data, offsets, T.ALNUM))[0, 0]] = np.log(1 / 3)  # a chance of 0.25
    model = toxicity.Model(w, np.zeros((2, 2)), 0.0)
    docs = spark.createDataFrame([(1, "vile " * 5), (2, "vile"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got == {1: pytest.approx(1 - 0.75**5), 2: pytest.approx(0.25), 3: 0.0}
