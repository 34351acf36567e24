"""BM25: corpus statistics, vocabulary, sparse vectors, pair scores.

A model is two tables: ``stats(doc_count, total_len, avgdl)``, one row, and
``vocab(term, df, idf[, term_id])``. Term counts are made inside the row, so a
corpus is shuffled by term for the statistics and not at all for the counts.
Where a model and vectors are made of the same texts, the written table of
``term_counts`` stands for the texts, which are tokenised once.
The vocabulary grows with the corpus and is never broadcast by hint: it is a
written table, whose size Spark knows when it picks the join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawspark.functions import text as tx
from lawspark.functions.text import let, segment, tokens, word_text
from lawspark.session import scratch_dir, shuffles_dropped, written

# BM25 constants.
K1 = 1.5
B = 0.75

SLICE = 1 << 20  # bytes of text whose counts are in memory at once, about

Segmenter = Callable[[], Callable[[list[str]], list[str]]]


@dataclass(frozen=True)
class BM25Model:
    stats: DataFrame
    vocab: DataFrame
    k1: float = K1
    b: float = B

    @cached_property
    def avgdl(self) -> float:
        """Read once from the one row of statistics."""
        return self.stats.first()["avgdl"]


def tokenise(
    docs: DataFrame, id_col: str, text_col: str = "text", segmenter: Segmenter | None = None
) -> DataFrame:
    """``(id, tokens)``."""
    text = segment(F.coalesce(F.col(text_col), F.lit("")), segmenter)
    return docs.select(id_col, tokens(text).alias("tokens"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, text)``, the text as ``word_text`` leaves it, to ``(id, doc_len, term_counts)``."""
    for b in batches:
        size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            own = b.slice(at, end - at)
            # Whitespace of Python is the set that ``tokens`` splits at.
            counts = [Counter(t.split()) for t in own.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, counts)], dtype=np.int32)
            listed = pa.StructArray.from_arrays(
                [pa.array(list(chain.from_iterable(counts)), pa.string()),
                 pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int64())],
                names=["term", "tf"],
            )
            yield pa.record_batch(
                [own.column(0), pa.array([c.total() for c in counts], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), listed)],
                names=[b.schema.names[0], "doc_len", "term_counts"],
            )


def term_counts(
    docs: DataFrame, id_col: str, text_col: str = "text", segmenter: Segmenter | None = None
) -> DataFrame:
    """``(id, doc_len, term_counts array<struct<term,tf>>)``, one row per text, its terms in no order.

    ``docs`` that hold these columns are taken as they are: all that needs
    counts takes a (written) table of them in the place of the texts.
    """
    if "term_counts" in docs.columns:
        return docs.select(id_col, "doc_len", "term_counts")
    text = segment(F.coalesce(F.col(text_col), F.lit("")), segmenter)
    kept = docs.select(id_col, word_text(text).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(_counted, f"`{id_col}` {kind}, doc_len bigint, term_counts array<struct<term:string,tf:bigint>>")


def distinct_terms(tokenised: DataFrame) -> DataFrame:
    """Each term once per text.

    The outer form is used where a computed array is exploded: for the inner
    one Spark adds a filter on the array's size, and would tokenise twice.
    """
    terms = tokenised.select(F.explode_outer(F.array_distinct("tokens")).alias("term"))
    return terms.where(F.col("term").isNotNull())


def query_terms(
    queries: DataFrame, text_col: str = "text", segmenter: Segmenter | None = None
) -> DataFrame:
    """Distinct terms of all queries."""
    t = tokenise(queries.withColumn("__id", F.lit(0)), "__id", text_col, segmenter)
    return distinct_terms(t).distinct()


def _idf(df: Column, doc_count: Column) -> Column:
    return F.log((doc_count - df + 0.5) / (df + 0.5) + 1)


def corpus_counts(
    docs: DataFrame,
    text_col: str = "text",
    segmenter: Segmenter | None = None,
    only_terms: DataFrame | None = None,
) -> DataFrame:
    """``(term, df, len)`` of a corpus, in one pass over it; what a model is made of.

    Each text lists its distinct terms once, and a null that stands for the
    text itself and carries its length: one aggregation by term, combined
    before the shuffle, yields the document frequencies and, in the null row,
    the number and length of the texts (empty ones included). Counts of
    disjoint corpora add up, and those of removed texts can be taken off.
    """
    counts = term_counts(docs.withColumn("__id", F.lit(0)), "__id", text_col, segmenter)
    text_itself = F.array(F.lit(None).cast("string"))
    listed = counts.select(
        F.col("doc_len").alias("len"),
        F.explode_outer(F.concat(text_itself, F.col("term_counts.term"))).alias("term"),
    )
    if only_terms is not None:
        itself = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("term"))
        asked = written(only_terms.select("term").unionByName(itself), "terms")
        listed = listed.join(asked, listed["term"].eqNullSafe(asked["term"]), "left_semi")
    return listed.groupBy("term").agg(
        F.count("*").alias("df"),
        F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("len"),
    )


def model_of(terms: DataFrame, k1: float = K1, b: float = B) -> BM25Model:
    """The model of a written table of ``corpus_counts``."""
    total = F.coalesce(F.max("len"), F.lit(0)).cast("bigint")
    stats = terms.where("term IS NULL").agg(
        F.coalesce(F.max("df"), F.lit(0).cast("bigint")).alias("doc_count"), total.alias("total_len")
    ).select(
        "doc_count", "total_len",
        F.when(F.col("doc_count") > 0, F.col("total_len") / F.col("doc_count"))
        .otherwise(0.0).alias("avgdl"),
    )
    vocab = terms.where("term IS NOT NULL").select(
        "term", "df", _idf(F.col("df"), stats.select("doc_count").scalar()).alias("idf")
    )
    return BM25Model(stats, vocab, k1, b)


def fit(
    docs: DataFrame,
    text_col: str = "text",
    segmenter: Segmenter | None = None,
    k1: float = K1,
    b: float = B,
    only_terms: DataFrame | None = None,
) -> BM25Model:
    """Statistics and idf of a corpus, in one pass over it.

    ``docs`` are texts, or ``term_counts`` of texts. What is counted over all of
    them is written to the shared scratch folder, so that every use
    reads it and Spark knows its size when it plans joins with it.

    ``only_terms(term)`` keeps the vocabulary to the terms a search asks for:
    weights of other terms never enter a dot product, so results are the same.
    They are a written table, applied before counting; Spark picks the join by
    its size.
    """
    return model_of(written(corpus_counts(docs, text_col, segmenter, only_terms), "bm25"), k1, b)


def with_term_ids(model: BM25Model, partitions: int | None = None) -> BM25Model:
    """Number the terms from 0 in code-point order.

    Terms are range-partitioned and sorted, and written once to the shared
    scratch folder with their place in their partition; the id is that place
    plus the number of terms in earlier partitions. The offsets table has one
    row per partition, so broadcasting it is safe, and no task sees the whole
    vocabulary. Writing fixes the partition bounds, which are sampled.
    """
    spark = model.vocab.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_dir(spark, "bm25-terms")
    # The upper bits of the generated id are the partition, the lower 33 the place in it.
    made = F.monotonically_increasing_id()
    with shuffles_dropped(spark):
        (
            model.vocab.select("term", "df", "idf")
            .repartitionByRange(n, "term").sortWithinPartitions("term")
            .withColumn("part", F.shiftright(made, 33))
            .withColumn("place", made.bitwiseAND(F.lit((1 << 33) - 1)))
            .write.parquet(path)
        )
    placed = spark.read.parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset")
    )
    numbered = placed.join(F.broadcast(offsets), "part").select(
        "term", (F.col("place") + F.col("offset")).alias("term_id"), "df", "idf"
    )
    return BM25Model(model.stats, numbered, model.k1, model.b)


def _norm(doc_len: Column, model: BM25Model) -> Column:
    """Length part of the weight. An empty corpus has no terms to weigh."""
    relative = doc_len / model.avgdl if model.avgdl else F.lit(0.0)
    return model.k1 * (1 - model.b + model.b * relative)


def _saturated(tf: Column, norm: Column, model: BM25Model) -> Column:
    return tf * (model.k1 + 1) / (tf + norm)


def _weight(idf: Column, tf: Column, doc_len: Column, model: BM25Model) -> Column:
    return idf * _saturated(tf, _norm(doc_len, model), model)


def weights(
    docs: DataFrame,
    model: BM25Model,
    id_col: str,
    text_col: str = "text",
    segmenter: Segmenter | None = None,
) -> DataFrame:
    """Postings ``(id, term[, term_id], idf, weight)`` of the known terms.

    Unknown terms are dropped but count in the length.
    """
    counts = term_counts(docs, id_col, text_col, segmenter)
    post = counts.select(id_col, "doc_len", F.inline_outer("term_counts"))
    known = post.where(F.col("term").isNotNull()).join(model.vocab, "term")
    ids = ["term_id"] if "term_id" in model.vocab.columns else []
    w = _weight(F.col("idf"), F.col("tf"), F.col("doc_len"), model)
    return known.select(id_col, "term", *ids, "idf", w.alias("weight"))


def sparse_vectors(
    docs: DataFrame,
    model: BM25Model,
    id_col: str,
    text_col: str = "text",
    segmenter: Segmenter | None = None,
    key: str = "term_id",
    keep_empty: bool = True,
) -> DataFrame:
    """``(id, indices, values)``, indices ascending; one row per text.

    ``key`` names the index column: ``term_id`` for stored vectors, or ``term``
    for vectors used at once, which needs no numbering. A vector is as long as
    its text has distinct terms.
    """
    post = weights(docs, model, id_col, text_col, segmenter)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("i"), F.col("weight").alias("w"))))
    vec = post.groupBy(id_col).agg(pairs.alias("p")).select(
        id_col, F.col("p.i").alias("indices"), F.col("p.w").alias("values")
    )
    if not keep_empty:
        return vec
    index_type = vec.schema["indices"].dataType
    return docs.select(id_col).join(vec, id_col, "left").select(
        id_col,
        F.coalesce("indices", F.array().cast(index_type)).alias("indices"),
        F.coalesce("values", F.array().cast("array<double>")).alias("values"),
    )


def search_vectors(
    docs: DataFrame,
    queries: DataFrame,
    model: BM25Model,
    id_col: str,
    query_id: str,
    text_col: str = "text",
    segmenter: Segmenter | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides of a search over texts (or their ``term_counts``) that have no stored vectors.

    The dot product is a sum of ``(query weight * idf) * (document weight / idf)``.
    With the idf on the side of the few queries, the document side needs no
    vocabulary: it is made inside the row, and the corpus is not shuffled.
    """
    items = item_vectors(docs, model, id_col, text_col, segmenter)
    return items, query_vectors(queries, model, query_id, text_col, segmenter)


def item_vectors(
    docs: DataFrame, model: BM25Model, id_col: str, text_col: str = "text", segmenter: Segmenter | None = None
) -> DataFrame:
    """``(id, indices, values)`` of texts, without the idf, which ``query_vectors`` hold: a map over the texts."""
    counts = term_counts(docs, id_col, text_col, segmenter)
    share = let(_norm(F.col("doc_len"), model), lambda n: F.transform(
        F.col("term_counts.tf"), lambda tf: _saturated(tf, n, model)
    ))
    return counts.select(id_col, F.col("term_counts.term").alias("indices"), share.alias("values"))


def query_vectors(
    queries: DataFrame, model: BM25Model, query_id: str, text_col: str = "text", segmenter: Segmenter | None = None
) -> DataFrame:
    """``(id, indices, values)`` of queries, with the idf of both sides; the known terms only."""
    post = weights(queries, model, query_id, text_col, segmenter)
    q = post.groupBy(query_id).agg(
        F.collect_list(F.struct("term", (F.col("weight") * F.col("idf")).alias("w"))).alias("p")
    )
    return q.select(query_id, F.col("p.term").alias("indices"), F.col("p.w").alias("values"))


def pair_scores(
    pairs: DataFrame,
    model: BM25Model,
    keys: list[str],
    query_col: str = "query",
    text_col: str = "text",
    segmenter: Segmenter | None = None,
) -> DataFrame:
    """Textbook BM25 of given (query, text) pairs: ``(keys, score)``.

    A repeated query token counts each time; the text need not be in the
    corpus; pairs without a common term score 0. Query terms are counted
    against the text inside the row, so that one small row per query term,
    and no text, goes to the join with the vocabulary.
    """
    norm = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = pairs.select(
        *keys,
        tokens(segment(norm(query_col), segmenter)).alias("q_tokens"),
        tokens(segment(norm(text_col), segmenter)).alias("d_tokens"),
    ).withColumn("doc_len", F.size("d_tokens").cast("bigint"))
    # Of the text, only tokens the query holds are counted.
    hits = let(F.array_distinct("q_tokens"), lambda q: F.filter(
        "d_tokens", lambda x: F.array_contains(q, x)
    ))
    found = let(tx.term_counts(hits), lambda c: F.transform(
        tx.term_counts(F.col("q_tokens")),
        lambda q: F.struct(
            q["term"].alias("term"), q["tf"].alias("qtf"),
            F.coalesce(
                F.get(F.filter(c, lambda d: d["term"] == q["term"]), F.lit(0))["tf"],
                F.lit(0).cast("bigint"),
            ).alias("tf"),
        ),
    ))
    rows = t.select(*keys, "doc_len", F.inline_outer(found))
    w = _weight(F.col("idf"), F.col("tf"), F.col("doc_len"), model)
    part = F.when(F.col("idf").isNotNull() & (F.col("tf") > 0), F.col("qtf") * w).otherwise(0.0)
    return (
        rows.join(model.vocab.select("term", "idf"), "term", "left")
        .groupBy(*keys).agg(F.sum(part).alias("score"))
    )
