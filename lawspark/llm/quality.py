"""Quality classifier: hashed word n-grams, logistic regression, FTRL.

Tokens are words (letters, digits) and runs of other signs. Features are
hashed: each token, each pair of neighbours, each pair of token shapes (a sign
run itself, an upper-case, capitalised, numeric or other word), and one
feature for a token that repeats its neighbour. A document is the sparse
vector of its features' shares, so that texts of all lengths compare. The
weights are learnt by follow-the-regularised-leader updates, one document at a
time, and a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lawspark.llm import text as T
from lawspark.llm.sampling import labelled_sample, with_texts

BITS = 18
PER_CLASS = 3000  # training documents of each class at most
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.0005, 0.001
EPOCHS = 4
GAIN = 20.0  # a feature's value is its share of all features, times this

_SIGN = T.NOT_SPACE & ~T.ALNUM
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash, shape and text of each token, in order."""
    word, sign = T.words(data, offsets, T.ALNUM), T.words(data, offsets, _SIGN)
    start = np.concatenate([word.start, sign.start])
    end = np.concatenate([word.end, sign.end])
    doc = np.concatenate([word.doc, sign.doc])
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], end[order], doc[order]
    h = T.span_hashes(T.prefix_sums(word), start, end)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    n_upper, size = upper[end] - upper[start], end - start
    first = _UPPER[data[start]] if len(start) else np.zeros(0, np.int64)
    shape = np.where((n_upper > 1) & (2 * n_upper >= size), 1, np.where(first == 1, 2, 3))
    shape = np.where(digit[end] - digit[start] > 0, 4, shape).astype(np.uint64)
    return h, np.where(order < len(word.start), shape, h), doc


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each feature occurrence."""
    h, shape, doc = _tokens(data, offsets)
    pair, pair_doc = T.ngrams(h, doc, 2)
    form, _ = T.ngrams(shape, doc, 2)
    next_to = doc[:-1] == doc[1:]
    same = (h[:-1] == h[1:])[next_to]
    pair = np.where(same, np.uint64(12345), pair)
    every = np.concatenate([h, pair, T.mix(form + np.uint64(1))])
    return (every >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([doc, pair_doc, pair_doc])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = T.utf8(b.column("text"))
        at, value = [], []
        for i, j in T.slices(offsets):
            bucket, doc = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            order = np.argsort(doc, kind="stable")
            bucket, cut = bucket[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))])
            for d in range(j - i):
                f, n = np.unique(bucket[cut[d] : cut[d + 1]], return_counts=True)
                at.append(f.astype(np.int32))
                value.append((GAIN * n / max(1, n.sum())).astype(np.float32))
        yield pa.record_batch(
            [b.column("doc_id"), b.column("y"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
            names=["doc_id", "y", "at", "value"],
        )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 3) -> np.ndarray:
    """Weights by FTRL-proximal updates; the last entry is the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        shrunk = np.sign(zi) * L1 - zi
        return np.where(np.abs(zi) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            at, value, y = rows[r]
            i, x = np.append(at, size), np.append(value, 1.0)
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")
    at, value = (table.column(c).combine_chunks() for c in ("at", "value"))
    cut = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    at, value = at.flatten().to_numpy(), value.flatten().to_numpy()
    rows = [(at[a:b], value[a:b], y) for a, b, y in zip(cut[:-1], cut[1:], table.column("y").to_pylist(), strict=True)]
    w = ftrl(rows)
    at = np.flatnonzero(w)
    return pa.table({"at": pa.array(at), "w": pa.array(w[at])})


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> np.ndarray:
    """Weights from at most ``per_class`` usable labelled documents of each class.

    The sample is bounded, and so is the weight table that comes back.
    Without labels all weights are 0, and every score is 0.5.
    """
    sample = with_texts(docs, labelled_sample(labels, "quality", usable, (per_class, per_class)))
    vectors = sample.mapInArrow(_vectors, "doc_id long, y int, at array<int>, value array<float>")
    fitted = vectors.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(_fit, "at long, w double").toArrow()
    w = np.zeros((1 << BITS) + 1)
    w[fitted.column("at").to_numpy()] = fitted.column("w").to_numpy()
    return w


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with ``score``: the chance of label 1, from the text alone.

    Null and empty texts get the score of the bias. A column ``score`` that
    ``docs`` has already is replaced.
    """
    docs = docs.drop("score")
    shipped = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        for b in batches:
            data, offsets = T.utf8(b.column("text"))
            out = np.zeros(b.num_rows)
            for i, j in T.slices(offsets):
                bucket, doc = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total = np.bincount(doc, weights=w[bucket], minlength=j - i)
                out[i:j] = GAIN * total / np.maximum(1, np.bincount(doc, minlength=j - i))
            p = 1.0 / (1.0 + np.exp(-np.clip(out + w[-1], -30, 30)))
            yield pa.record_batch([*b.columns, pa.array(p)], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)
