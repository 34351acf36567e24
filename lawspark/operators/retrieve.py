"""Questions against a stored collection: search, fuse, rerank, and give the passages.

``index_collection`` writes, from the rows of a collection, a vector index,
block-max postings, the lexical model they were weighted with, and the payload.
``retrieve`` answers a table of questions from these alone: no passage is
tokenised, embedded or scored in full unless it can be a result.

Passages are told apart by a number of 60 bits of their id where ids are
digests, which have the order of the ids; the id itself is in the payload only.
The postings hold no idf, which the questions' side has, so that they are made
inside the row, and the payload is written in place: neither texts nor
postings by id are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawspark.operators import lexical, postings, vector_index
from lawspark.operators.dense import DENSE_THRESHOLD, TOP_K, embed
from lawspark.operators.lexical import BM25Model, Segmenter
from lawspark.operators.postings import Postings
from lawspark.operators.search import PREFETCH, RERANK_TOP_N, candidate_limit, cross_encode, rerank, rrf
from lawspark.operators.vector_index import VectorIndex
from lawspark.session import shuffles_dropped, written
from lawspark.sources.model_store import load_model, save_model

METADATA = [
    "doc_id", "document_title", "chapter_number", "chapter_title", "article_number", "article_title",
    "article_category", "clause_number", "point", "is_point", "references", "type", "chapter_total", "article_total",
]


@dataclass(frozen=True)
class StoredCollection:
    vectors: VectorIndex
    postings: Postings | None
    model: BM25Model | None
    payload: DataFrame  # key, id, text, metadata; the key is what stands for the id in the index


def metadata(columns: list[str]) -> Column:
    """Everything of a point but its text and vectors, as JSON text; ``parse_json`` makes a variant of it."""
    return F.to_json(F.struct(*[c for c in METADATA if c in columns]))


def _number() -> Column:
    """First 15 of the hex digits of ``chunk_id``."""
    return F.conv(F.substring("chunk_id", 1, 15), 16, 10).cast("bigint")


def _key(points: DataFrame) -> Column:
    """What stands for ``chunk_id``: a number of the same order, or the id where one is no digest or two share a number."""
    if points.schema["chunk_id"].dataType.simpleString() != "string":
        return F.col("chunk_id")
    number = F.when(F.col("chunk_id").rlike("^[0-9a-f]{64}$"), _number()).alias("number")
    with shuffles_dropped(points.sparkSession):
        odd = points.select(number).groupBy("number").count().where("number is null or count > 1")
        return _number() if odd.isEmpty() else F.col("chunk_id")


def index_collection(
    points: DataFrame, path: str, model: BM25Model | None, distance: str = "cosine", segmenter: Segmenter | None = None
) -> StoredCollection:
    """Index ``points(chunk_id, text, dense, …)`` in the folder ``path``.

    Without a model there are no postings, and search is by vectors alone.
    """
    key = _key(points).alias("key")
    vector_index.build(points.select(key, "dense"), f"{path}/vectors", distance)
    payload = points.select(key, F.col("chunk_id").alias("id"), "text", metadata(points.columns).alias("metadata"))
    # As the points lie, by document, where a passage is like the one before it.
    payload.write.option("compression", "zstd").parquet(f"{path}/payload")
    if model is not None:
        save_model(model, f"{path}/model")
        postings.build(lexical.item_vectors(points.select(key, "text"), model, "key", segmenter=segmenter), f"{path}/postings")
    return load_collection(points.sparkSession, path, model is not None)


def load_collection(spark: SparkSession, path: str, lexical_too: bool = True) -> StoredCollection:
    stored = postings.load(spark, f"{path}/postings") if lexical_too else None
    return StoredCollection(
        vector_index.load(spark, f"{path}/vectors"), stored,
        load_model(spark, f"{path}/model") if lexical_too else None, spark.read.parquet(f"{path}/payload"),
    )


def candidates(
    stored: StoredCollection, questions: DataFrame, limit: int, threshold: float = DENSE_THRESHOLD,
    segmenter: Segmenter | None = None, digits: int = 6,
) -> DataFrame:
    """``query_id, id, total_score, dense_score, sparse_score, rank`` for ``questions(query_id, text, dense)``.

    ``id`` is the key of the payload. Both lists, ``PREFETCH`` times as long as asked, fused by rank. Without
    postings the vectors' list alone, with its threshold. A question without a
    vector finds nothing.
    """
    vectors = questions.select("query_id", "dense")
    if stored.postings is None:
        found = vector_index.search(stored.vectors, vectors, limit, threshold, digits)
        return found.select(
            "query_id", "id", F.col("score").alias("total_score"), F.col("score").alias("dense_score"),
            F.lit(0.0).alias("sparse_score"), "rank",
        )
    able = questions.where(F.size("dense") > 0).select("query_id", "text")
    terms = written(lexical.query_vectors(able, stored.model, "query_id", segmenter=segmenter), "terms")
    dense = vector_index.search(stored.vectors, vectors, PREFETCH * limit, digits=digits)
    sparse = postings.search(stored.postings, terms, PREFETCH * limit, digits)
    return rrf(dense, sparse, limit, digits=digits)


def retrieve(
    stored: StoredCollection,
    queries: DataFrame,
    open_model: Callable,
    limit: int = TOP_K,
    threshold: float = DENSE_THRESHOLD,
    segmenter: Segmenter | None = None,
    open_reranker: Callable | None = None,
    top_n: int = RERANK_TOP_N,
) -> DataFrame:
    """``query_id, rank, id, total_score, sparse_score, dense_score, text, metadata``.

    ``queries(query_id, text)``. ``open_model`` embeds the questions as the
    passages were embedded. With ``open_reranker``, a model of (question,
    passage) pairs, four times ``top_n`` candidates are scored by it and the
    best ``top_n`` kept; otherwise the ``limit`` best of the fused lists.
    Null texts count as empty ones.
    """
    asked = queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = written(asked.withColumn("dense", embed(F.col("text"), open_model, segmenter)), "questions")
    n = candidate_limit(True, limit, top_n) if open_reranker else limit
    # Few rows, and written, so that Spark knows it and reads the payload in place.
    found = written(candidates(stored, asked, n, threshold, segmenter), "found")
    rows = stored.payload.join(found.withColumnRenamed("id", "key"), "key")
    if open_reranker:
        question = asked.select("query_id", F.col("text").alias("question"))
        scored = rows.join(question, "query_id").withColumn(
            "new", cross_encode(F.col("question"), F.col("text"), open_reranker)
        )
        rows = rerank(scored, top_n, "new")
    return rows.select("query_id", "rank", "id", "total_score", "sparse_score", "dense_score", "text", "metadata")


_CITED = (
    "document_title string, chapter_number bigint, article_number bigint, article_title string, "
    "clause_number bigint, point string, type string"
)


def with_citation(found: DataFrame) -> DataFrame:
    """Results with the columns of their metadata that a cited context shows."""
    return found.withColumn("__m", F.from_json("metadata", _CITED)).select("*", "__m.*").drop("__m")
