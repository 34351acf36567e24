"""Stored postings in blocks of like impact, and a search that skips blocks.

``build`` writes, for each term, blocks of at most about ``BLOCK`` postings
whose weights lie in one of ``LEVELS`` steps below the term's highest weight. A
block's largest weight is kept beside it, which is all that is read
of blocks that are skipped. A term in every text is many blocks in many tasks:
blocks are made by grouping on (term, level, part), never by sorting a list.
The vectors themselves are kept, numbered by the place they were written at, so
that a candidate's whole score can be looked up. Blocks hold numbers, which
are close to each other, and no ids; they are shuffled once, as lists
of a term that batches of vectors have brought together.

``search`` first scores a few ids from the blocks that promise most; the k-th
score found is the threshold. Then each query is given a cut per term such that
all cuts together stay below the threshold: an id that reaches it must exceed
the cut of some term, so only blocks above their term's cut are read. Cuts go
to the longest lists first, so that frequent terms are mostly or wholly
skipped. The ids found there, each once however many queries found it, are
scored in full from their vectors, block by block of ids and queries: a pair of
query and id is never a row, and k rows of a query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawspark.operators.dense import TOP_K
from lawspark.operators.search import _lists, sparse_search
from lawspark.session import shuffles_dropped, written

BLOCK = 1024  # postings of a block, about
LEVELS = 32  # steps of weight below the highest of the term
SEED_POSTINGS = 4096  # postings read for a query before there is a threshold
_SLACK = 2e-6  # more than rounding of scores and sums can move a score


@dataclass(frozen=True)
class Postings:
    blocks: DataFrame  # term, level, part, most, n, ids (numbers of vectors), weights
    terms: DataFrame  # term, most, n
    vectors: DataFrame  # number, id, indices, values


def _added_up(pairs: Column) -> Column:
    """``(term, weight)`` pairs with each term once: what bounds a posting must bound all an id has of its term."""
    terms = F.array_distinct(pairs["term"])
    sums = F.transform(terms, lambda t: F.struct(
        t.alias("term"),
        F.aggregate(F.filter(pairs, lambda p: p["term"] == t), F.lit(0.0), lambda a, p: a + p["weight"]).alias("weight"),
    ))
    return F.when(F.size(terms) == F.size(pairs), pairs).otherwise(sums)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(number, indices, values)`` to ``(term, numbers, weights)``, a row for each term of a batch."""
    for b in batches:
        row, term = _lists(b.column(1))
        weight = _lists(b.column(2))[1].to_numpy(zero_copy_only=False)
        if not len(term):
            continue
        coded = term.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
        number = b.column(0).to_numpy(zero_copy_only=False)[row[order]]
        yield pa.record_batch(
            [coded.dictionary, pa.ListArray.from_arrays(pa.array(ends), pa.array(number)),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(weight[order]))],
            names=["term", "numbers", "weights"],
        )


def _save(rows: DataFrame, path: str) -> DataFrame:
    with shuffles_dropped(rows.sparkSession):
        rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def build(vectors: DataFrame, path: str, block: int = BLOCK, levels: int = LEVELS) -> Postings:
    """Write postings of ``vectors(id, indices, values)`` to the folder ``path``.

    Weights that are null or not above 0 add nothing and are left out, and so
    are vectors without an id. Several vectors of one id add up; only where
    there are some are vectors brought together by id.
    """
    spark = vectors.sparkSession
    iid, indices, values = vectors.columns[:3]
    pairs = F.arrays_zip(F.col(indices).alias("term"), F.col(values).cast("array<double>").alias("weight"))
    rows = vectors.where(F.col(iid).isNotNull()).select(F.col(iid).alias("id"), F.filter(pairs, lambda p: p["weight"] > 0).alias("p"))

    def numbered(rows: DataFrame, folder: str) -> DataFrame:
        added = rows.select("id", _added_up(F.col("p")).alias("p"))
        return _save(added.select(
            F.monotonically_increasing_id().alias("number"), "id", F.col("p.term").alias("indices"), F.col("p.weight").alias("values")
        ), folder)

    own = numbered(rows, f"{path}/vectors")
    with shuffles_dropped(spark):
        repeated = not own.groupBy(F.xxhash64("id").alias("h")).count().where("count > 1").isEmpty()
    if repeated:
        each = own.select("id", F.arrays_zip(F.col("indices").alias("term"), F.col("values").alias("weight")).alias("p"))
        own = numbered(each.groupBy("id").agg(F.flatten(F.collect_list("p")).alias("p")), f"{path}/added")
    kind = own.schema["indices"].dataType.elementType.simpleString()
    lists = own.select("number", "indices", "values").mapInArrow(
        _inverted, f"term {kind}, numbers array<bigint>, weights array<double>"
    )
    # Terms are as many as the vocabulary: a written table, whose size Spark knows when it joins.
    terms = _save(lists.groupBy("term").agg(
        F.max(F.array_max("weights")).alias("most"), F.sum(F.size("numbers")).alias("n")
    ), f"{path}/terms")
    level = F.least(F.floor((1 - F.col("weight") / F.col("most")) * levels), F.lit(levels - 1)).cast("int").alias("level")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / (block * F.lit(1.0)))).cast("long")
    part = F.pmod(F.xxhash64("number"), parts).alias("part")
    each = lists.join(terms, "term").select("term", "most", "n", F.inline(F.arrays_zip(F.col("numbers").alias("number"), F.col("weights").alias("weight"))))
    grouped = each.select("term", level, part, "number", "weight").groupBy("term", "level", "part").agg(
        F.max("weight").alias("most"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("p")
    )
    grouped = grouped.select("term", "level", "part", "most", "n", F.col("p.number").alias("ids"), F.col("p.weight").alias("weights"))
    _save(grouped.sortWithinPartitions("term", "level"), f"{path}/blocks")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Postings:
    blocks, terms, vectors = (spark.read.parquet(f"{path}/{n}") for n in ("blocks", "terms", "vectors"))
    try:
        vectors = spark.read.parquet(f"{path}/added")  # in the place of vectors some of which share their id
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return Postings(blocks, terms, vectors)


def _terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, q_weight`` of ``queries(id, indices, values)``."""
    qid, indices, values = queries.columns[:3]
    each = queries.select(
        F.col(qid).alias("query_id"), F.inline(F.arrays_zip(F.col(indices).alias("term"), F.col(values).alias("q_weight")))
    )
    return each.where("q_weight > 0").groupBy("query_id", "term").agg(F.sum("q_weight").cast("double").alias("q_weight"))


def _best(stored: Postings, asked: DataFrame, ids: DataFrame, k: int, digits: int) -> DataFrame:
    """``query_id, id, score, rank``: the k best of the vectors of the given numbers, scored in full."""
    own = stored.vectors.join(ids, "number", "left_semi").select("id", "indices", "values")
    lists = F.collect_list(F.struct("term", "q_weight")).alias("p")
    queries = asked.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(lists).select(
        "query_id", F.col("p.term").alias("indices"), F.col("p.q_weight").alias("values")
    )
    return sparse_search(own, queries, k, digits).where("score > 0")


def _cuts(asked: DataFrame, floor: DataFrame) -> DataFrame:
    """``query_id, term, q_weight, cut``: what a term may add unseen; the sum of a query stays below its floor."""
    most = F.col("q_weight") * F.col("most")
    longest = Window.partitionBy("query_id").orderBy(F.desc("n"), F.asc("term")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("floor") - F.coalesce(F.sum(most).over(longest), F.lit(0.0))
    with_floor = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    return with_floor.select("query_id", "term", "q_weight", F.least(most, F.greatest(left, F.lit(0.0))).alias("cut"))


def _plan(stored: Postings, queries: DataFrame, k: int, digits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Asked terms, blocks read for the threshold, and ``cuts(query_id, term, q_weight, cut, floor)``."""
    asked = written(_terms(queries).join(stored.terms, "term"), "asked")
    heads = stored.blocks.select("term", "level", "part", F.col("most").alias("block_most"), F.col("n").alias("block_n"))
    promise = Window.partitionBy("query_id").orderBy(F.desc(F.col("q_weight") * F.col("block_most")), "term", "level", "part")
    before = F.coalesce(F.sum("block_n").over(promise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The highest level of each term is enough to begin with; it bounds the rows a query sorts.
    first_level = heads.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.min("level").alias("level"))
    tops = written(heads.join(first_level, ["term", "level"]), "heads")
    seeds = asked.select("query_id", "term", "q_weight").join(tops, "term").withColumn("before", before)
    seeds = written(
        seeds.where(F.col("before") < SEED_POSTINGS).select("query_id", "term", "level", "part", "block_n"), "seeds"
    )
    found = _ids(stored, seeds)
    best = _best(stored, asked, written(found, "first"), k, digits)
    floor = best.where(F.col("rank") == k).select("query_id", (F.col("score") - _SLACK).alias("floor"))
    floor = written(floor, "floor")
    cuts = written(_cuts(asked, floor).join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))), "cuts")
    return asked, seeds, cuts


def _read(stored: Postings, cuts: DataFrame) -> DataFrame:
    """Blocks above their term's cut, once for each query that reads them, without their lists."""
    heads = stored.blocks.select("term", "level", "part", "most", "n")
    return heads.join(cuts, "term").where(F.col("most") * F.col("q_weight") > F.col("cut"))


def _ids(stored: Postings, blocks: DataFrame) -> DataFrame:
    """The numbers of vectors in the given ``blocks(term, level, part)``, each once."""
    key = ["term", "level", "part"]
    return stored.blocks.join(blocks.select(*key).distinct(), key, "left_semi").select(F.explode("ids").alias("number")).distinct()


def search(stored: Postings, queries: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)``: the k highest dot products of ``queries(id, indices, values)``.

    Equal to scoring every list in full: ids that share no term are no result,
    equal scores go by id.
    """
    asked, _, cuts = _plan(stored, queries, k, digits)
    # An id that reaches a query's threshold exceeds the cut of some term, so it is in a block read here.
    able = written(_ids(stored, _read(stored, cuts)), "able")
    return _best(stored, asked, able, k, digits)


def share_read(stored: Postings, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """``term, n, queries, share``: how much of each asked term's list the searches read, blocks of the first look included."""
    asked, seeds, cuts = _plan(stored, queries, k, 6)
    later = _read(stored, cuts).select("query_id", "term", F.col("n").alias("block_n"))
    both = seeds.select("query_id", "term", "block_n").unionByName(later)
    read = both.groupBy("term").agg(F.sum("block_n").alias("read"))
    lists = asked.groupBy("term").agg(F.max("n").alias("n"), F.count("*").alias("queries"))
    return lists.join(read, "term", "left").select(
        "term", "n", "queries", (F.coalesce("read", F.lit(0)) / (F.col("n") * F.col("queries"))).alias("share")
    )
