"""A training corpus from ``documents``: filter, deduplicate, decontaminate, redact, pack.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept. All but the last return the columns of ``documents``.

Edge cases hold in every stage: null and empty texts are texts without words
(quality scores them by its bias, they duplicate nothing, hold no passage and
no personal data, and pack as their end id); null ids are ordinary ids; rows
that repeat id and text are one document after near-duplicate removal; empty
tables give empty tables.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lawspark.llm import decontam, minhash, packing, pii, quality  # noqa: E402
from lawspark.llm.queries import tokenizer_path  # noqa: E402
from lawspark.llm.tables import crc32_of_id, table  # noqa: E402
from lawspark.session import written  # noqa: E402


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc32_of_id() % 3 != 1)
    return quality.score(docs, model).where("score >= 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, then text hash; null ids last."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    own_hash = "__text"
    while own_hash in docs.columns:  # a column of that name is the caller's
        own_hash += "_"
    found = minhash.near_duplicates(docs.withColumn(own_hash, text), carry=(own_hash,))
    group = [F.col("component"), F.col("doc_id").alias("__id"), F.col(own_hash).alias("__hash")]
    fate = written(found.groupBy(*group).agg(F.count("*").alias("n")), "groups")
    order = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    first = fate.groupBy("component").agg(F.min(order).alias("first"))
    first = first.select(F.col("first.__id").alias("first_id"), F.col("first.__hash").alias("first_hash")).distinct()
    is_first = F.col("__id").eqNullSafe(F.col("first_id")) & (F.col("__hash") == F.col("first_hash"))
    fate = fate.groupBy("__id", "__hash").agg(F.sum("n").alias("n")).join(first, is_first, "left")
    fate = written(fate.select("__id", "__hash", F.col("first_hash").isNotNull().alias("kept"), "n"), "fates")
    own = docs.withColumn(own_hash, text)
    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(own_hash) == F.col("__hash"))
    rest = own.join(fate.where("not kept"), here, "left_anti")
    again = fate.where("kept and n > 1")
    if not again.isEmpty():  # the same row several times: one of them stays
        once = rest.join(again, here, "left_semi").dropDuplicates(["doc_id", own_hash])
        rest = rest.join(again, here, "left_anti").unionByName(once)
    return rest.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage beyond the contract's share."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii.redact(docs, pii.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences."""
    # Shorter runs than packing alone: workers of the stages before and after keep their memory.
    pieces = packing.tokenise(docs, tokenizer_path(), run_bytes=1 << 20)
    narrow = pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "piece", "deal"
    )
    return packing.place(narrow).drop("piece")


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: A trained classifier and randomised packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
