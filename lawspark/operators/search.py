"""Retrieval: sparse search, rank fusion, dense fallback, reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawspark.operators.dense import DENSE_THRESHOLD, TOP_K, nearest
from lawspark.operators.lexical import weights
from lawspark.operators.topk import top_k
from lawspark.session import written

# Settings of the retrieval step.
RRF_K = 60
PREFETCH = 2  # candidates per list, as a multiple of the results wanted
RERANK_TOP_N = 5
RERANK_DEPTH = 4  # fused candidates to rerank, as a multiple of the results wanted


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row of each element, and the elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), column.flatten()


def _sparse_scorer(queries: pa.Table):
    """Dot product of sparse vectors, from the terms that item and query share.

    The work is the number of such hits, and the memory one score block.
    """
    q_row, q_term = _lists(queries.column(1))
    q_weight = _lists(queries.column(2))[1].to_numpy(zero_copy_only=False)
    known = q_term.unique()
    term = pc.index_in(q_term, value_set=known).to_numpy(zero_copy_only=False)
    built: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def postings(cut: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a slice of queries, by term: where each term's list begins, its queries and weights."""
        if (cut.start, cut.stop) not in built:
            mine = np.flatnonzero((q_row >= cut.start) & (q_row < cut.stop))
            mine = mine[np.argsort(term[mine], kind="stable")]
            first = np.searchsorted(term[mine], np.arange(len(known) + 1))
            built[cut.start, cut.stop] = (first, q_row[mine] - cut.start, q_weight[mine])
        return built[cut.start, cut.stop]

    def score(items, cut: slice) -> np.ndarray:
        first, who, how = postings(cut)
        width = cut.stop - cut.start
        row, own = _lists(items.column(1))
        weight = _lists(items.column(2))[1].to_numpy(zero_copy_only=False)
        at = pc.index_in(own, value_set=known)
        hit = at.is_valid().to_numpy(zero_copy_only=False)
        row, weight, col = row[hit], weight[hit], at.drop_null().to_numpy(zero_copy_only=False)
        out = np.zeros(items.num_rows * width)
        step = 1 << 16
        for k in range(0, len(col), step):
            c = col[k : k + step]
            n = first[c + 1] - first[c]
            j = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(row[k : k + step], n) * width + who[j]
            out += np.bincount(cell, np.repeat(weight[k : k + step], n) * how[j], len(out))
        s = out.reshape(items.num_rows, width)
        return np.where(s > 0, s, -np.inf)

    return score


def sparse_search(
    items: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int | None = 6, **limits
) -> DataFrame:
    """Top-k by dot product of sparse vectors: ``(query_id, id, score, rank)``.

    Both tables hold an id, indices and values, in this order. Only items that
    share a term with the query are results.
    """
    usable = queries.where(F.size(queries.columns[1]) > 0)
    # Items are not filtered here: a condition on a computed vector would move
    # below it and compute it twice. The scorer passes over empty vectors.
    return top_k(items, usable, _sparse_scorer, k, digits, **limits)


def postings(docs: DataFrame, model, id_col: str, name: str, buckets: int = 16, **options) -> DataFrame:
    """Write ``(term, id, weight)`` of a corpus as the table ``name``, bucketed and sorted by term.

    A search then reads the corpus's weights, not its texts.
    """
    rows = weights(docs, model, id_col, **options).select("term", F.col(id_col).alias("id"), "weight")
    rows.write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(name)
    return docs.sparkSession.table(name)


def postings_search(
    stored: DataFrame, queries: DataFrame, model, query_id: str, k: int = TOP_K, digits: int = 6, **options
) -> DataFrame:
    """``(query_id, id, score, rank)`` over stored postings; scores of shared terms only.

    Only the asked terms' lists take part. What they say of an id is brought
    together once, however many queries ask, and scored block by block: a pair
    of query and id is never a row, and k rows of a query leave a task.
    """
    asked = written(weights(queries, model, query_id, **options).select(
        "term", F.col(query_id).alias("query_id"), F.col("weight").alias("q_weight")
    ), "asked")
    own = _gathered(stored.join(asked.select("term").distinct(), "term", "left_semi"), "id", "weight")
    return sparse_search(own, _gathered(asked, "query_id", "q_weight"), k, digits).where("score > 0")


def _gathered(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """``key, indices, values`` of ``(key, term, weight)`` rows."""
    pairs = F.collect_list(F.struct("term", F.col(weight).alias("weight"))).alias("p")
    return rows.groupBy(key).agg(pairs).select(key, F.col("p.term").alias("indices"), F.col("p.weight").alias("values"))


def rrf(
    dense: DataFrame, sparse: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K, digits: int = 6
) -> DataFrame:
    """Reciprocal rank fusion: ``sum(1 / (rrf_k + rank))`` over the two lists.

    ``(query_id, id, total_score, dense_score, sparse_score, rank)``. Partial
    scores are null where a list lacks the item; an item in one list counts.
    """
    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.select(
            "query_id", "id", "rank",
            F.col("score").alias(own), F.lit(None).cast("double").alias(other),
        )

    both = side(dense, "dense_score", "sparse_score").unionByName(
        side(sparse, "sparse_score", "dense_score")
    )
    fused = both.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), digits).alias("total_score"),
        F.max("dense_score").alias("dense_score"),
        F.max("sparse_score").alias("sparse_score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("total_score"), F.asc("id"))
    return fused.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def hybrid_search(
    dense_items: DataFrame,
    dense_queries: DataFrame,
    sparse_items: DataFrame | None = None,
    sparse_queries: DataFrame | None = None,
    limit: int = TOP_K,
    distance: str = "cosine",
    rrf_k: int = RRF_K,
    threshold: float = DENSE_THRESHOLD,
    prefetch: int = PREFETCH,
    **limits,
) -> DataFrame:
    """Dense and sparse search, ``prefetch * limit`` each, fused to ``limit``.

    Without a lexical model (``sparse_items`` is None) the dense list alone,
    and only then with the score threshold. A query without a vector gives no
    rows in either mode.
    """
    if sparse_items is None:
        found = nearest(dense_items, dense_queries, limit, distance, threshold, **limits)
        return found.select(
            "query_id", "id", F.col("score").alias("total_score"),
            F.col("score").alias("dense_score"), F.lit(0.0).alias("sparse_score"), "rank",
        )
    q = dense_queries
    with_vector = q.where(F.size(q.columns[1]) > 0).select(F.col(q.columns[0]).alias("__q"))
    sq = sparse_queries.join(
        with_vector, sparse_queries[sparse_queries.columns[0]] == F.col("__q"), "left_semi"
    )
    dense = nearest(dense_items, q, limit * prefetch, distance, **limits)
    sparse = sparse_search(sparse_items, sq, limit * prefetch, **limits)
    return rrf(dense, sparse, limit, rrf_k)


def candidate_limit(rerank: bool, top_k: int = TOP_K, top_n: int = RERANK_TOP_N) -> int:
    """How many fused results to fetch."""
    return top_n * RERANK_DEPTH if rerank else top_k


def rerank(
    candidates: DataFrame, top_n: int = RERANK_TOP_N, score_col: str | None = None
) -> DataFrame:
    """Order by a new score and keep ``top_n``; equal scores keep fusion order.

    ``score_col`` replaces ``total_score``. Without it reranking is off: the
    first ``top_n`` in fusion order.
    """
    if score_col is None:
        return candidates.where(F.col("rank") <= top_n)
    w = Window.partitionBy("query_id").orderBy(F.desc(score_col), F.asc("rank"))
    return (
        candidates.withColumn("__new", F.row_number().over(w).cast("bigint"))
        .where(F.col("__new") <= top_n)
        .withColumns({"total_score": F.col(score_col), "rank": F.col("__new")})
        .drop("__new", score_col)
    )


def cross_encode(
    query, text, open_model: Callable[[], Callable[[list[tuple[str, str]]], object]]
):
    """Score column of (query, text) pairs by a caller's model, opened once per task."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = open_model()
        for q, t in batches:
            pairs = list(zip(q.fillna(""), t.fillna(""), strict=True))
            yield pd.Series(np.asarray(model(pairs), dtype="float64"))

    return run(query, text)


def with_payload(results: DataFrame, items: DataFrame, id_col: str) -> DataFrame:
    """Join text and payload back to result rows.

    Give it written results (``session.written``): they are few, and knowing
    that, Spark broadcasts them and reads the item table in place.
    """
    return items.withColumnRenamed(id_col, "id").join(results, "id")
