"""Exact top-k of every query over a large item table, by block products.

The score of all (query, item) pairs is needed for an exact answer, but no
pair is ever a row: inside each task a block of items is multiplied with a
block of queries (numpy), and only the k best items of each query leave it.
What is shuffled is at most k rows per query and task.

Queries come to the tasks in blocks of at most ``MAX_BYTES``, measured by Spark
before anything is shipped; the item table is read in place, once per block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20
CELLS = 1 << 22  # size of one score block: items x queries

# A scorer is made once per task from the query table. It takes a batch of
# items and a slice of queries and returns an (items x queries) score array;
# -inf marks pairs that are no candidates.
Scorer = Callable[[pa.Table | pa.RecordBatch, slice], np.ndarray]
OpenScorer = Callable[[pa.Table], Scorer]


def _best(scores: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Positions of the k highest scores >= floor; equal scores by position."""
    if len(scores) > k:
        floor = max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
    if floor == -np.inf:
        return np.flatnonzero(scores > -np.inf)
    above = np.flatnonzero(scores > floor)
    ties = np.flatnonzero(scores == floor)[: max(0, k - len(above))]
    return np.concatenate([above, ties])


def _round(scores: np.ndarray, digits: int | None) -> np.ndarray:
    scores = np.where(np.isnan(scores), -np.inf, scores)
    return scores if digits is None else np.round(scores, digits)


class _Search:
    """Keeps, per query, the k-th best score seen in this task as the floor."""

    def __init__(self, queries: pa.Table, open_scorer: OpenScorer, k: int, digits, threshold):
        self.ids = queries.column(0)
        self.n = queries.num_rows
        self.k = k
        self.digits = digits
        self.score = open_scorer(queries)
        start = -np.inf if threshold is None else threshold
        self.floor = np.full(self.n, start)
        self.top = np.full((self.n, k), -np.inf)

    def block(self, items: pa.RecordBatch) -> pa.RecordBatch | None:
        """Candidates of one item batch: ``query_id, id, score``."""
        order = pc.sort_indices(items.column(0))
        items = items.take(order)  # by id, so that equal scores resolve by id
        q_pos, i_pos, out = [], [], []
        width = max(1, min(self.n, 512))
        height = max(1, CELLS // width)
        for at in range(0, items.num_rows, height):
            part = items.slice(at, height)
            for q0 in range(0, self.n, width):
                cut = slice(q0, min(self.n, q0 + width))
                scores = _round(self.score(part, cut), self.digits)
                for j in range(cut.stop - cut.start):
                    q = q0 + j
                    column = scores[:, j]
                    picked = _best(column, self.k, self.floor[q])
                    if not len(picked):
                        continue
                    values = column[picked]
                    merged = np.concatenate([self.top[q], values])
                    self.top[q] = np.partition(merged, len(merged) - self.k)[-self.k:]
                    self.floor[q] = max(self.floor[q], self.top[q].min())
                    q_pos.append(np.full(len(picked), q))
                    i_pos.append(picked + at)
                    out.append(values)
        if not out:
            return None
        return pa.record_batch(
            [
                _flat(self.ids).take(pa.array(np.concatenate(q_pos))),
                items.column(0).take(pa.array(np.concatenate(i_pos))),
                pa.array(np.concatenate(out).astype("float64")),
            ],
            names=["query_id", "id", "score"],
        )


def _flat(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks)
    return joined


def top_k(
    items: DataFrame,
    queries: DataFrame,
    open_scorer: OpenScorer,
    k: int,
    digits: int | None = 6,
    threshold: float | None = None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``(query_id, id, score, rank)``: ranks from 1, equal scores by id.

    The first column of ``items`` and of ``queries`` is the id; the other
    columns are the scorer's. Scores are rounded before ranking, because sums
    in another order differ in the last bits. A score that is no number is no
    result.
    """
    qid, iid = queries.columns[0], items.columns[0]
    schema = (
        f"query_id {queries.schema[qid].dataType.simpleString()}, "
        f"id {items.schema[iid].dataType.simpleString()}, score double"
    )
    arrays = [c for c, kind in queries.dtypes if kind.startswith("array")]
    size = sum((16 * F.greatest(F.size(c), F.lit(0)) for c in arrays), F.lit(64)).cast("bigint")
    total = queries.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, math.ceil(total / max_bytes))
    candidates = None
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == i) if blocks > 1 else queries
        found = _over_scan(items, part.toArrow(), open_scorer, k, digits, threshold, schema)
        candidates = found if candidates is None else candidates.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return candidates.withColumn("rank", F.row_number().over(w).cast("bigint")).where(
        F.col("rank") <= k
    )


def _over_scan(items, query_table, open_scorer, k, digits, threshold, schema) -> DataFrame:
    shipped = items.sparkSession.sparkContext.broadcast(query_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        if table.num_rows == 0:
            return
        search = _Search(table, open_scorer, k, digits, threshold)
        for batch in batches:
            found = search.block(batch)
            if found is not None:
                yield found

    return items.mapInArrow(run, schema)
