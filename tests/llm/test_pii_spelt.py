"""Every spelling that the expression of spelt-out addresses takes is tried."""

import numpy as np

from lawspark.llm import pii


def test_spelt_addresses_are_candidates(spark):
    texts = [
        f"write to jane {at} example {dot} com now"
        for at in ("at", "AT", "[at]", "[AT]", "(at)", "(AT)")
        for dot in ("dot", "DOT", "[dot]", "[DOT]", "(dot)", "(DOT)")
    ] + ["write to jane(at)example(DOT)com now", "write to jane[AT]example[DOT]com now"]
    for t in texts:
        assert pii._SPELT.search(t), t
        assert any(c.kind == 0 and not c.base for c in pii.candidates(t)), t
    weights = np.array([0.0] * pii.N_FEATURES + [10.0])  # takes every candidate
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not [r.text for r in pii.redact(docs, weights).collect() if "example" in r.text]
