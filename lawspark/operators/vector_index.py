"""Exact nearest neighbours over stored vectors, by cells and rings that can be skipped.

``build`` fits centres on a bounded sample, puts every vector into the cell of
its nearest centre and writes the cells as partitions, each sorted by the
distance to the centre and cut into rings of at most ``BLOCK`` vectors. A table
of rings keeps their smallest and largest distance.

``search`` looks into the cells nearest to a query until they hold k vectors;
the k-th distance found is the limit for the rest. By the triangle inequality a
vector at distance d from its centre is at least ``|d - d(query, centre)|`` away
from the query, so rings beyond the limit are not read, and cells without a
ring in reach are not listed. What is left gives the same answer as comparing
everything. Blocks of queries meet rings in tasks of bounded size; neither
queries nor vectors pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawspark.operators.dense import TOP_K, _matrix, _unit, l2_normalise
from lawspark.session import shuffles_dropped, written

PER_CELL = 2048  # vectors of a cell on average
MAX_CELLS = 1024  # bounds the centres, which are sent to every task
SAMPLE = 64  # sampled vectors for each centre
BLOCK = 2048  # vectors of a ring at most
QUERIES = 1024  # queries compared with a ring in one task, about
_SLACK = 1e-6  # more than rounding can move a distance or a score


@dataclass(frozen=True)
class VectorIndex:
    vectors: DataFrame  # cell, block, id, v, d
    blocks: DataFrame  # cell, block, n, low, high
    centres: DataFrame  # cell, centre, n, low, high
    distance: str


def _with(df: DataFrame, more: str) -> StructType:
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def _placed(centres: np.ndarray, unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            m = _unit(v) if unit else v
            near = np.zeros(len(m), np.int32)
            d = np.zeros(len(m))
            for i in range(0, len(m), 1024):
                part = m[i : i + 1024]
                near[i : i + 1024] = ((centres * centres).sum(1) - 2 * part @ centres.T).argmin(axis=1)
                d[i : i + 1024] = np.linalg.norm(part - centres[near[i : i + 1024]], axis=1)
            yield pa.record_batch([b.column("id"), b.column("v"), pa.array(near), pa.array(d)], names=["id", "v", "cell", "d"])

    return run


def build(items: DataFrame, path: str, distance: str = "cosine", cells: int | None = None, seed: int = 7) -> VectorIndex:
    """Write an index of ``items(id, vector)`` to the folder ``path``.

    ``distance`` is cosine or euclid. Items without a vector are left out.
    ``cells`` is by default the number of vectors by ``PER_CELL``, at most
    ``MAX_CELLS``; centres are fitted on about ``SAMPLE`` vectors each.
    """
    if distance not in ("cosine", "euclid"):
        raise ValueError(f"no index for distance: {distance}")
    spark = items.sparkSession
    iid, vec = items.columns[:2]
    rows = items.select(F.col(iid).alias("id"), F.col(vec).alias("v")).where(F.size("v") > 0)
    n = rows.count()
    k = max(1, min(MAX_CELLS, cells or -(-n // PER_CELL)))
    point = l2_normalise(F.col("v")) if distance == "cosine" else F.transform("v", lambda x: x.cast("double"))
    share = min(1.0, k * SAMPLE / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    sample = written(some.select(array_to_vector(point).alias("features")), "sample")
    k = min(k, sample.count())
    if k > 1:
        centres = np.stack(KMeans(k=k, seed=seed, maxIter=10).fit(sample).clusterCenters())
    else:
        first = rows.select(point.alias("p")).first()
        centres = np.array([first["p"]]) if first else np.zeros((1, 1))
    schema = _with(rows, "cell int, d double")
    placed = rows.mapInArrow(_placed(centres, distance == "cosine"), schema)
    # Ranges of (cell, distance): a large cell takes several partitions, each a run of rings.
    order = F.monotonically_increasing_id()
    ranged = placed.repartitionByRange("cell", "d", "id").sortWithinPartitions("cell", "d")
    with shuffles_dropped(spark):
        blocked = ranged.withColumn("block", F.floor(order / BLOCK).cast("long"))
        blocked.write.option("compression", "zstd").partitionBy("cell").parquet(f"{path}/vectors")
    # An index of nothing has no partitions that tell the columns.
    shape = ["d double", "block long", "cell int"]
    rows.select("id", "v", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in shape]).limit(0).write.parquet(f"{path}/empty")
    vectors = spark.read.schema(_with(rows, ", ".join(shape))).parquet(f"{path}/vectors")
    vectors.groupBy("cell", "block").agg(
        F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")
    ).write.parquet(f"{path}/blocks")
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    of_cell = spark.read.parquet(f"{path}/blocks").groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    made.join(of_cell, "cell").withColumn("distance", F.lit(distance)).coalesce(1).write.parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    centres = spark.read.parquet(f"{path}/centres")
    blocks = spark.read.parquet(f"{path}/blocks")
    some = centres.select("distance").first()
    if some is None:
        return VectorIndex(spark.read.parquet(f"{path}/empty"), blocks, centres, "cosine")
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), blocks, centres.drop("distance"), some["distance"])


def _reach(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance between a query at ``d`` from a centre and what lies between ``low`` and ``high`` from it."""
    return np.maximum(0.0, np.maximum(low - d, d - high))


def _cells(cells: pa.Table, k: int, unit: bool):
    """Cells to look into: without a limit the nearest ones that hold k vectors, else the others in reach."""
    centre = _matrix(cells.column("centre"))
    number, n, low, high = (cells.column(c).to_numpy() for c in ("cell", "n", "low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("q"))
            q = _unit(q) if unit else q
            limit = b.column("tau").to_numpy(zero_copy_only=False).astype("float64")
            row, cell, at = [], [], []
            for i, one in enumerate(q):
                d = np.linalg.norm(centre - one, axis=1)
                order = np.argsort(d, kind="stable")
                first = order[: np.searchsorted(np.cumsum(n[order]), k) + 1]
                if np.isnan(limit[i]):
                    own = first
                else:
                    own = np.flatnonzero(_reach(d, low, high) <= limit[i])
                    own = own[~np.isin(own, first)]
                row.append(np.full(len(own), i))
                cell.append(number[own])
                at.append(d[own])
            rows = pa.array(np.concatenate(row))
            yield pa.record_batch(
                [b.column("query_id").take(rows), b.column("q").take(rows), b.column("tau").take(rows),
                 pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(at))],
                names=["query_id", "q", "tau", "cell", "dq"],
            )

    return run


def asked_blocks(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, q, tau, cell, dq, block, n``: the rings that the queries have to look into.

    ``queries(query_id, q, tau)``: with a null ``tau`` the first cells, else the rings within it.
    """
    # At most MAX_CELLS rows.
    cells = index.centres.toArrow()
    schema = _with(queries, "cell int, dq double")
    if not cells.num_rows:
        return queries.where("false").select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("dq"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("n"))
    wanted = queries.mapInArrow(_cells(cells, k, index.distance == "cosine"), schema)
    reach = F.greatest(F.lit(0.0), F.col("low") - F.col("dq"), F.col("dq") - F.col("high"))
    inside = F.col("tau").isNull() | (reach <= F.col("tau"))
    return wanted.join(index.blocks, "cell").where(inside).drop("low", "high")


def _compared(k: int, distance: str, digits: int, floor: float | None):
    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        none = {"query_id": queries.column("query_id").slice(0, 0), "id": items.column("id").slice(0, 0), "score": pa.array([], pa.float64())}
        if not items.num_rows or not queries.num_rows:
            return pa.table(none)
        items = items.sort_by("id")
        m, q = _matrix(items.column("v")), _matrix(queries.column("q"))
        if distance == "cosine":
            s = np.round(_unit(q) @ _unit(m).T, digits)
        else:
            s = np.stack([-np.sqrt(((m - one) ** 2).sum(1)) for one in q]).round(digits)
        s = np.where(np.isnan(s), -np.inf, s)
        # What is below the k-th score found before is no result: no row of it leaves the task.
        tau = queries.column("tau").to_numpy().astype("float64")
        s = np.where(s >= np.where(np.isnan(tau), -np.inf, _least(tau, distance) - 10.0 ** -digits)[:, None], s, -np.inf)
        if floor is not None:
            s = np.where(s >= floor, s, -np.inf)
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # equal scores by id
        row = np.repeat(np.arange(len(q)), best.shape[1])
        score = s[row, best.ravel()]
        good = score > -np.inf
        return pa.table({
            "query_id": queries.column("query_id").take(pa.array(row[good])), "id": items.column("id").take(pa.array(best.ravel()[good])),
            "score": pa.array(score[good]),
        })

    return run


def _candidates(index: VectorIndex, asked: DataFrame, groups: int, k: int, digits: int, floor: float | None) -> DataFrame:
    """The k best of each asked ring for each query that asks it."""
    key = ["cell", "block", "part"]
    asked = asked.select("cell", "block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part"), "query_id", "q", "tau")
    rings = asked.select(*key).distinct()
    items = index.vectors.select("cell", "block", "id", "v").join(rings, ["cell", "block"]).select(
        *[F.col(c).alias(c) for c in key], "id", "v"  # columns of their own, apart from those of ``asked``
    )
    qtype, itype = asked.schema["query_id"].dataType.simpleString(), items.schema["id"].dataType.simpleString()
    return items.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        _compared(k, index.distance, digits, floor), f"query_id {qtype}, id {itype}, score double"
    )


def _limit(score: Column, distance: str) -> Column:
    """Distance beyond which nothing scores as well."""
    if distance == "cosine":
        return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (score - _SLACK))) + _SLACK
    return -score + _SLACK


def _least(tau: np.ndarray, distance: str) -> np.ndarray:
    """The score at a limit, lowered by the slack."""
    if distance == "cosine":
        return 1 - np.maximum(0.0, tau - _SLACK) ** 2 / 2 - _SLACK
    return -tau - _SLACK


def _first_cells(
    index: VectorIndex, queries: DataFrame, k: int, threshold: float | None, digits: int
) -> tuple[DataFrame, DataFrame, DataFrame, int, float | None]:
    """Queries without and with the limit that the first cells give, and what was found there."""
    qid, vec = queries.columns[:2]
    empty = F.lit(None).cast("double").alias("tau")
    rows = queries.select(F.col(qid).alias("query_id"), F.col(vec).alias("q"), empty).where(F.size("q") > 0)
    rows = written(rows, "queries")
    groups = max(1, -(-rows.count() // QUERIES))
    floor = threshold if index.distance == "cosine" or threshold is None else -threshold
    first = written(_candidates(index, asked_blocks(index, rows, k), groups, k, digits, floor), "first")
    kth = _ranked(first, k).where(F.col("rank") == k).select(
        F.col("query_id").alias("__q"), _limit(F.col("score"), index.distance).alias("found")
    )
    most = _limit(F.lit(floor), index.distance) if floor is not None else F.lit(float("inf"))
    limited = rows.drop("tau").join(kth, F.col("query_id").eqNullSafe(F.col("__q")), "left").select(
        "query_id", "q", F.least(F.coalesce("found", F.lit(float("inf"))), most).alias("tau")
    )
    return rows, written(limited, "limited"), first, groups, floor


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def search(
    index: VectorIndex, queries: DataFrame, k: int = TOP_K, threshold: float | None = None, digits: int = 6
) -> DataFrame:
    """``(query_id, id, score, rank)``, as ``dense.nearest`` gives it for the same rows.

    ``queries`` holds an id and a vector, in this order; a query without a
    vector finds nothing. ``threshold`` is a lower bound of the similarity, or
    an upper bound of the distance.
    """
    _, limited, first, groups, floor = _first_cells(index, queries, k, threshold, digits)
    rest = _candidates(index, asked_blocks(index, limited, k), groups, k, digits, floor)
    found = _ranked(first.unionByName(rest), k)
    return found if index.distance == "cosine" else found.withColumn("score", -F.col("score"))


def share_read(index: VectorIndex, queries: DataFrame, k: int = TOP_K, threshold: float | None = None) -> float:
    """Share of all (query, vector) pairs that ``search`` compares."""
    rows, limited, _, _, _ = _first_cells(index, queries, k, threshold, 6)
    asked = asked_blocks(index, rows, k).unionByName(asked_blocks(index, limited, k))
    read = asked.agg(F.sum("n")).first()[0] or 0
    total = (index.blocks.agg(F.sum("n")).first()[0] or 0) * rows.count()
    return read / total if total else 0.0
