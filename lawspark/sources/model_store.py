"""The lexical model as two tables in a folder, each version a partition of both."""

from __future__ import annotations

import logging
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lawspark.operators.lexical import BM25Model

log = logging.getLogger("lawspark.sources")


def save_model(model: BM25Model, path: str) -> None:
    """Add a version: its vocabulary, then its statistics, which make it known.

    Earlier versions stay, so a model can be saved where it was loaded from,
    and a failure between the two leaves the last whole version in force. A
    failure is logged, not raised.
    """
    version = time.time_ns()
    try:
        model.vocab.write.parquet(f"{path}/vocab/version={version}")
        stats = model.stats.withColumns({"k1": F.lit(model.k1), "b": F.lit(model.b)})
        stats.write.parquet(f"{path}/stats/version={version}")
    except Exception as e:
        log.error("model not saved to %s: %s", path, e)


def load_model(spark: SparkSession, path: str) -> BM25Model | None:
    """The newest model, or None where none can be read: search is then dense only."""
    try:
        stats = spark.read.parquet(f"{path}/stats")
        last = stats.orderBy(F.desc("version")).first()
        version = last["version"]
        stats = stats.where(F.col("version") == version).drop("version", "k1", "b")
        vocab = spark.read.parquet(f"{path}/vocab").where(F.col("version") == version).drop("version")
        return BM25Model(stats, vocab, last["k1"], last["b"])
    except Exception as e:
        log.error("model not loaded from %s: %s", path, e)
        return None
