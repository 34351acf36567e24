"""Dense vectors: embedding hook, unit length, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawspark.functions.text import segment
from lawspark.operators.topk import top_k

# Result count and score threshold of the settings.
TOP_K = 7
DENSE_THRESHOLD = 0.4

# Higher is nearer for all: distances are negated while ranking.
_SIMILARITIES = ("cosine", "dot")
_DISTANCES = ("euclid", "manhattan")


def l2_normalise(vector: Column) -> Column:
    """Scale to unit length; a zero vector stays as it is."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # The norm is an array of one, so that it is computed once per row and not per element.
    return F.flatten(F.transform(
        F.array(norm),
        lambda n: F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(v),
    ))


def embed(
    text: Column,
    open_model: Callable[[], Callable[[list[str]], object]],
    segmenter: Callable[[], Callable[[list[str]], list[str]]] | None = None,
    batch_size: int = 64,
) -> Column:
    """Embed texts with a caller's model, scaled to unit length.

    ``open_model`` is called once per task and returns a function from a list
    of texts to one vector each; texts go to it in batches of ``batch_size``.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = open_model()
        for batch in batches:
            texts = batch.fillna("").tolist()
            rows = []
            for at in range(0, len(texts), batch_size):
                v = np.asarray(model(texts[at:at + batch_size]), dtype="float64")
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                rows.extend(np.divide(v, norm, out=v, where=norm > 0).astype("float32"))
            yield pd.Series(rows, dtype="object")

    return run(segment(text, segmenter))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column to a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and size.min() != size.max():
        raise ValueError(f"vectors of different sizes: {int(size.min())} and {int(size.max())}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _scorer(distance: str):
    def open_scorer(queries: pa.Table):
        q = _matrix(queries.column(1))
        if distance == "cosine":
            q = _unit(q)

        def score(items, cut: slice) -> np.ndarray:
            column = items.column(1)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if (size > 0).all():
                return near(_matrix(column), q[cut])
            out = np.full((len(size), len(q[cut])), -np.inf)  # items without a vector
            if (size > 0).any():
                out[size > 0] = near(_matrix(column.filter(pa.array(size > 0))), q[cut])
            return out

        def near(v: np.ndarray, part: np.ndarray) -> np.ndarray:
            if v.shape[1] != part.shape[1]:
                raise ValueError(f"items have vectors of size {v.shape[1]}, queries of {part.shape[1]}")
            if distance == "cosine":
                return _unit(v) @ part.T
            if distance == "dot":
                return v @ part.T
            out = np.empty((len(v), len(part)))
            for j, one in enumerate(part):
                d = v - one
                out[:, j] = -(np.abs(d).sum(1) if distance == "manhattan" else np.sqrt((d * d).sum(1)))
            return out

        return score

    return open_scorer


def nearest(
    items: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    distance: str = "cosine",
    threshold: float | None = None,
    digits: int | None = 6,
    **limits,
) -> DataFrame:
    """Exact nearest neighbours: ``(query_id, id, score, rank)``.

    ``items`` and ``queries`` hold an id and a vector, in this order. For
    ``cosine`` and ``dot`` the score is the similarity, higher first, and
    ``threshold`` a lower bound; for ``euclid`` and ``manhattan`` it is the
    distance, lower first, and ``threshold`` an upper bound. The threshold is
    applied before the ranking.
    """
    name = distance.lower()
    if name not in _SIMILARITIES + _DISTANCES:
        raise ValueError(f"unknown distance: {distance}")
    vec = queries.columns[1]
    usable = queries.where(F.size(vec) > 0)  # a query without a vector finds nothing
    is_distance = name in _DISTANCES
    floor = -threshold if is_distance and threshold is not None else threshold
    found = top_k(items, usable, _scorer(name), k, digits, floor, **limits)
    return found.withColumn("score", -F.col("score")) if is_distance else found
