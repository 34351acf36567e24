"""Near-duplicates of vectors: spherical k-means cells, blocked cosine products.

Equal vectors are one *node* with a count. Centres are fitted on a bounded
sample; every node then goes to the cell of its nearest centre (its home) and
visits each further cell whose centre is at most ``MARGIN`` less similar, with
no cap on their number. Inside a cell home members meet each other and the
visitors in blocks of about ``BLOCK`` rows, one task a pair of blocks; a task
emits one row per linked node (its number of links and a root), never a pair.

Members within half the linking angle of their own centre form the cell's
*core*. Any two of them are linked by the triangle inequality, so a core of any
size, such as a third of all rows that are near-copies, is counted and joined
by one aggregation and no product. Other rows meet a core only if they are near
enough to link with its outermost member.

A pair is missed only if neither vector visits the other's home. That bound is
not exact, which no division into cells of such vectors can be: the README
gives the recall measured against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lawspark.llm.components import components
from lawspark.session import written

COSINE = 0.9
CELL = 1024  # nodes a cell holds on average
MAX_CELLS = 4096  # bounds what is broadcast: so many centres
PER_CELL = 16  # sampled nodes for each centre: at most 65,536 are fitted on
MARGIN = 0.15
BLOCK = 2048
ROUNDS = 8
APART = 0.8  # seeds are less similar than this, so that a dense group gets one
CHUNK = 512  # rows of a block multiplied at once
_EPS = 1e-9
CORE, REST, VISITOR = 0, 1, 2


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values as double, where each list begins, and its length (0 where it cannot be used)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    lost = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype("float64")
    begin = np.cumsum(size) - size
    bad = np.zeros(len(size), np.int64)
    np.add.at(bad, np.repeat(np.arange(len(size)), size)[lost | ~np.isfinite(x)], 1)
    return x, begin, np.where(bad > 0, 0, size)


def unit_rows(x: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The given rows, all of one length, scaled to unit length."""
    m = x[begin[rows][:, None] + np.arange(size[rows[0]])] if len(rows) else np.zeros((0, 0))
    if not m.size:
        return m
    top = np.abs(m).max(axis=1, keepdims=True)
    m = np.divide(m, top, out=np.zeros_like(m), where=top > 0)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=m, where=norm > 0)


def _units(column) -> np.ndarray:
    x, begin, size = _lists(column)
    return unit_rows(x, begin, size, np.arange(len(size)))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("v")
        x, begin, size = _lists(v)
        x = x + 0.0  # -0.0 equals 0.0
        some = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x != 0, out=some[1:])
        dim = np.where(some[np.minimum(begin + size, len(x))] > some[np.minimum(begin, len(x))], size, 0)
        key = [xxhash.xxh3_128_digest(x[a : a + n].tobytes()) if n else None for a, n in zip(begin, dim, strict=True)]
        yield pa.record_batch([b.column("vec_id"), pa.array(key, pa.binary()), pa.array(dim), v], names=["vec_id", "key", "dim", "v"])


def fit_centres(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` unit centres of unit rows; fewer where the rows lie close together."""
    seeds = np.zeros((k, x.shape[1]))
    n = 0
    for row in x:
        if n == k:
            break
        if not n or (seeds[:n] @ row).max() < APART:
            seeds[n], n = row, n + 1
    c = seeds[:n]
    for _ in range(ROUNDS):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def centres(nodes: DataFrame, n: int, dim: int) -> np.ndarray:
    """Centres of a bounded sample of the nodes of length ``dim``; ``n`` is their number."""
    k = min(MAX_CELLS, max(1, -(-n // CELL)))
    order = F.xxhash64("key")
    share = min(1.0, PER_CELL * k / max(1, n))
    sample = nodes.where((F.col("dim") == dim) & (F.pmod(order, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    schema = "at long, c array<double>"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order")
        m = np.stack([np.asarray(v, "float64") for v in rows["v"]])
        m = unit_rows(m.ravel(), np.arange(len(m)) * dim, np.full(len(m), dim), np.arange(len(m)))
        found = fit_centres(m, k)
        return pd.DataFrame({"at": range(len(found)), "c": list(found)})

    # One group: the sample is bounded.
    got = sample.select("dim", "v", order.alias("order")).groupBy("dim").applyInPandas(run, schema).orderBy("at").toPandas()
    return np.stack(got["c"].to_list()) if len(got) else np.eye(1, dim)


def _assign(shipped, dim: int, margin: float, core_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x, begin, _ = _lists(b.column("v"))
                own = b.column("dim").to_numpy(zero_copy_only=False)
                home = np.where(own == dim, 0, -own)  # other lengths: a cell each, without a core
                core, visits, near = np.zeros(len(own), bool), [[h] for h in home.tolist()], [[0.0] for _ in own]
                rows = np.flatnonzero(own == dim)
                if len(rows):
                    s = np.clip(unit_rows(x, begin, own, rows) @ c.T, -1, 1)
                    home[rows] = s.argmax(axis=1)
                    best = s.max(axis=1)
                    core[rows] = best >= core_at
                    for i, r in enumerate(rows.tolist()):
                        cells = np.flatnonzero(s[i] >= best[i] - margin)
                        visits[r], near[r] = cells.tolist(), np.arccos(s[i, cells]).tolist()
                yield pa.record_batch(
                    [b.column("node"), b.column("n"), b.column("v"), pa.array(home), pa.array(core),
                     pa.array(visits, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.float64()))],
                    names=["node", "n", "v", "home", "core", "visits", "angles"],
                )

    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest label of each row's and column's component; rows are labelled first."""
    r, c = linked.shape
    left, right = np.arange(r), np.arange(r, r + c)
    big = r + c
    while True:
        new = np.array([np.where(row, right, big).min(initial=big) for row in linked]) if c else left
        new = np.minimum(left, new)
        down = np.full(c, big)
        for i in range(0, r, CHUNK):
            part = np.where(linked[i : i + CHUNK], new[i : i + CHUNK, None], big)
            down = np.minimum(down, part.min(axis=0, initial=big))
        down = np.minimum(right, down)
        if (new == left).all() and (down == right).all():
            return np.concatenate([left, right])
        left, right = new, down


def _compare(cosine: float):
    """Links between the two blocks of a task, or inside one block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cell, lk, i, rk, j = (t.column(x)[0].as_py() for x in ("cell", "lk", "i", "rk", "j"))
        side = t.column("side").to_numpy(zero_copy_only=False)
        parts = [t.filter(pa.array(side == s)) for s in (0, 1)]
        own = (lk, i) == (rk, j)
        left, right = (parts[0], parts[0]) if own else parts
        none = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        a, b = _units(left.column("v")), _units(right.column("v"))
        home = left.column("home").to_numpy()
        twice = home < cell  # visitors whose own cell comes first
        visits = right.column("visits").combine_chunks()
        if isinstance(visits, pa.ChunkedArray):
            visits = pa.concat_arrays(visits.chunks)
        size = visits.value_lengths().to_numpy()
        flat = visits.flatten().to_numpy()
        span = max(int(flat.max(initial=0)), int(home.max(initial=0))) + 1
        known = np.repeat(np.arange(len(size)), size)[flat >= 0] * span + flat[flat >= 0]
        linked = np.zeros((len(a), len(b)), bool)
        for at in range(0, len(a), CHUNK):
            part = a[at : at + CHUNK] @ b.T >= cosine
            if own:
                part[np.arange(len(part)), np.arange(at, at + len(part))] = False
            elif lk == VISITOR and twice[at : at + CHUNK].any():
                r, c = np.nonzero(part & twice[at : at + CHUNK, None])
                again = np.isin(c * span + home[at + r], known)
                part[r[again], c[again]] = False  # counted in the visitor's cell
            linked[at : at + CHUNK] = part
        nodes = [p.column("node").to_numpy() for p in (left, right)]
        counts = [p.column("n").to_numpy() for p in (left, right)]
        rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        small = linked[np.ix_(rows, cols)]
        name = np.concatenate([nodes[0][rows], nodes[1][cols]])
        if own:
            of_row = small.astype("float64") @ counts[1][cols]
            root = _roots(np.where(np.eye(len(rows), dtype=bool), True, small))[: len(rows)]
            return pa.table({"node": nodes[0][rows], "links": of_row.astype(np.int64), "to": name[root]})
        sums = np.concatenate([small.astype("float64") @ counts[1][cols], counts[0][rows].astype("float64") @ small])
        return pa.table({"node": name, "links": sums.astype(np.int64), "to": name[_roots(small)]})

    return run


def _blocks(count: Column) -> Column:
    return F.ceil(count / F.lit(BLOCK)).cast("int")


def _range(n: Column, make) -> Column:
    """One task for each block number below ``n``."""
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), make)


def _tasks(placed: DataFrame) -> DataFrame:
    """Rows of all block pairs: ``cell, lk, i, rk, j, side`` and the row."""
    def pair(lk: int, i: Column, rk: int, j: Column, side: int) -> Column:
        return F.struct(
            F.lit(lk).alias("lk"), i.alias("i"), F.lit(rk).alias("rk"), j.alias("j"), F.lit(side).alias("side")
        )

    def block(n: Column) -> Column:
        return F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")

    n_core, n_rest, n_vis, near_rest, near_vis = (
        _blocks(F.col(c)) for c in ("n_core", "n_rest", "n_visitor", "near_rest", "near_visitor")
    )
    none = _range(F.lit(0), lambda j: pair(0, j, 0, j, 0))
    at_core, at_rest, at_vis = block(n_core), block(n_rest), block(n_vis)
    near = F.col("near") & (F.col("n_core") > 0)

    def at_near(n: Column) -> Column:
        return block(n)

    rest = F.concat(
        F.transform(F.sequence(at_rest, F.greatest(n_rest - 1, at_rest)), lambda j: pair(REST, at_rest, REST, j, 0)),
        _range(at_rest, lambda i: pair(REST, i, REST, at_rest, 1)),
        F.when(near, _range(n_core, lambda j: pair(REST, at_near(near_rest), CORE, j, 0))).otherwise(none),
        _range(n_vis, lambda i: pair(VISITOR, i, REST, at_rest, 1)),
    )
    visitor = F.concat(
        _range(n_rest, lambda j: pair(VISITOR, at_vis, REST, j, 0)),
        F.when(near, _range(n_core, lambda j: pair(VISITOR, at_near(near_vis), CORE, j, 0))).otherwise(none),
    )
    core = F.concat(
        _range(near_rest, lambda i: pair(REST, i, CORE, at_core, 1)),
        _range(near_vis, lambda i: pair(VISITOR, i, CORE, at_core, 1)),
    )
    where = F.when(F.col("kind") == CORE, core).when(F.col("kind") == REST, rest).otherwise(visitor)
    return placed.select("cell", "node", "n", "v", "home", "visits", F.explode(where).alias("t")).select(
        "cell", "t.*", "node", "n", "v", "home", "visits"
    )


def near_vectors(rows: DataFrame, cosine: float = COSINE, margin: float = MARGIN) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``rows(vec_id, embedding)``.

    ``n_links`` counts the other rows linked directly, copies included, and
    ``component_id`` is the smallest vec_id reachable. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing: each
    is its own component. Vectors of different lengths are never linked.
    Repeated ids are rows of their own that share a name; a null id is never
    the smallest unless a component has no other, and ``kept`` compares
    null-safely. Other columns are left out; an empty table gives an empty one.
    """
    spark = rows.sparkSession
    kind = rows.schema["embedding"].dataType
    kind = kind if isinstance(kind, ArrayType) and kind.elementType.typeName() == "float" else ArrayType(
        StructType.fromDDL("x double")["x"].dataType
    )
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    schema = StructType.fromDDL("vec_id long, key binary, dim long").add("v", kind)
    read = rows.mapInArrow(_keys, schema).withColumn("row", F.monotonically_increasing_id())
    read = written(read, "vectors")
    nodes = written(
        read.where("key is not null").groupBy("key")
        .agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("vec_id").alias("vec_id"),
             F.first("dim").alias("dim"), F.first("v").alias("v")),
        "nodes",
    )
    # The most frequent length has cells; of any other length there is one cell each.
    main = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (main[0]["dim"], main[0]["n"]) if main else (1, 0)
    shipped = spark.sparkContext.broadcast(centres(nodes, n, dim))  # at most MAX_CELLS of them
    half, whole = math.acos(cosine) / 2, math.acos(cosine)
    added = StructType.fromDDL("home long, core boolean, visits array<long>, angles array<double>")
    schema = StructType([nodes.schema["node"], nodes.schema["n"], nodes.schema["v"], *added.fields])
    placed = written(nodes.mapInArrow(_assign(shipped, dim, margin, math.cos(half) + _EPS), schema), "placed")

    is_core, is_home = F.col("core") & (F.col("cell") == F.col("home")), F.col("cell") == F.col("home")
    at = placed.select("*", F.explode(F.arrays_zip("visits", "angles")).alias("z")).select(
        "node", "n", "v", "home", "visits", "core", F.col("z.visits").alias("cell"), F.col("z.angles").alias("angle")
    ).withColumn("kind", F.when(is_core, CORE).when(is_home, REST).otherwise(VISITOR))
    # One row a cell: the number of cells is bounded, but for odd vector lengths.
    narrow = at.select("cell", "kind", "angle", "node", "n")
    own = F.col("kind") == CORE
    cores = written(narrow.where(own).groupBy("cell").agg(
        F.max("angle").alias("radius"), F.min("node").alias("first"), F.sum("n").alias("weight"),
    ), "cores")
    near = F.coalesce(F.col("angle") <= F.col("radius") + whole + _EPS, F.lit(False))
    by_cell = narrow.join(cores.select("cell", "radius"), "cell", "left").withColumn("near", near)
    cells = written(by_cell.groupBy("cell").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{name}")
          for k, name in ((CORE, "core"), (REST, "rest"), (VISITOR, "visitor"))],
        *[F.sum((F.col("near") & (F.col("kind") == k)).cast("long")).alias(f"near_{name}")
          for k, name in ((REST, "rest"), (VISITOR, "visitor"))],
        F.first("radius").alias("radius"),
    ), "cells")
    tasks = _tasks(at.join(cells, "cell").withColumn("near", near))
    found = written(
        tasks.groupBy("cell", "lk", "i", "rk", "j").applyInArrow(_compare(cosine), "node long, links long, to long"), "links"
    )
    inside = placed.where("core").join(cores, F.col("home") == F.col("cell")).select(
        "node", (F.col("weight") - F.col("n")).alias("links"), F.col("first").alias("to")
    )
    both = found.unionByName(inside)
    label = components(both.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = both.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.select("key", "node", "vec_id", "n").join(label, "node", "left").join(links, "node", "left").select(
        "key", "vec_id", F.coalesce("root", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
    )
    least = rooted.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    owner = rooted.select("key", "component", "n_links").join(least, "component").select("key", "n_links", "component_id")
    out = read.select("vec_id", "key").join(owner, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
