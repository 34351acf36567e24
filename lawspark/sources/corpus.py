"""Corpora: raw texts and parsed documents, in and out."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawspark.functions.text import is_json_object
from lawspark.schemas import TREE

log = logging.getLogger("lawspark.sources")

_RAW = "doc_id string, text string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: ``(doc_id, text)``, the id being the file's path."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: each new file once."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def _checked(raw: DataFrame) -> DataFrame:
    """Add ``good``: the text is one JSON object with nothing after it."""
    return raw.withColumn("good", is_json_object(F.col("text")))


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed JSON documents, one per file: ``(documents, quarantined)``.

    A missing path, malformed JSON or a root that is no object gives no
    document; bad files are rows ``(doc_id, text)`` of the second table.
    Values of an unexpected type become null.
    """
    try:
        raw = _checked(read_texts(spark, path))
    except AnalysisException as e:
        log.error("no documents at %s: %s", path, e)
        raw = _checked(spark.createDataFrame([], _RAW))
    tree = F.from_json("text", TREE)
    good = raw.where("good").select("doc_id", tree.alias("d")).select("doc_id", "d.*")
    return good, raw.where(~F.col("good")).select("doc_id", "text")


def read_document_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed JSON documents, one per line of any number of files: ``(documents, quarantined)``.

    The id stands in the line. Bad lines are rows ``(doc_id, text)`` of the
    second table, the id being the path of their file; for the rest as
    ``read_documents``.
    """
    try:
        lines = spark.read.text(path)
        raw = _checked(lines.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")))
    except AnalysisException as e:
        log.error("no documents at %s: %s", path, e)
        raw = _checked(spark.createDataFrame([], _RAW))
    good = raw.where("good").select(F.from_json("text", f"doc_id string, {TREE}").alias("d")).select("d.*")
    return good, raw.where(~F.col("good")).select("doc_id", "text")


def lean(chapters: Column) -> Column:
    """Chapters as they are written: null in the place of empty ``points``."""
    def clause(k):
        return k.withField("points", F.when(F.size(k["points"]) > 0, k["points"]))

    def article(a):
        return a.withField("clauses", F.transform(a["clauses"], clause))

    def chapter(c):
        return c.withField("articles", F.transform(c["articles"], article))

    return F.transform(chapters, chapter)


def write_documents(tree: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parsed documents as JSON lines.

    Empty ``points`` and missing categories and references are left out of the
    text, since null fields are not written.
    """
    tree.withColumn("chapters", lean(F.col("chapters"))).write.mode(mode).json(path)
