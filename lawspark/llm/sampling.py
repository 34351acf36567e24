"""Bounded samples of labelled rows, chosen by hash, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(labels: DataFrame, label: str, usable: Column, bounds: tuple[int, int]) -> DataFrame:
    """``doc_id, y`` of at most ``bounds[y]`` labelled rows of each class.

    Labels other than 0 and 1, null ids and rows that ``usable`` excludes are
    left out; of several labels of one id the larger holds.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    out = None
    for y in (0, 1):
        # five standard deviations below the bound, so that chance does not pass it
        share = (bounds[y] - 5 * bounds[y] ** 0.5) / max(1, count.get(y, 0))
        some = known.where((F.col("y") == y) & (order < share))
        out = some if out is None else out.unionByName(some)
    return out


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, y, text`` of the sampled rows; the sample is bounded, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
