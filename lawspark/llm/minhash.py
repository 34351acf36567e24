"""Near-duplicates by one-permutation hashing with optimal densification.

A text's word shingles are hashed once; the hash's top bits choose a bin, each
bin keeps its smallest hash, and an empty bin takes the value of a filled bin
that a fixed sequence of random probes finds (optimal densification). Bins are
banded into buckets. Texts with equal shingle sets are one *node*, so exact
copies cost one narrow row each.

A text most of whose shingles no other candidate has cannot be linked and
leaves its buckets; such are the many that share one passage and little else.
Within a bucket the candidate links form stars: every member is linked with
the smallest one, then members of buckets that still hold several components
with the next ``CENTRES`` smallest. Texts that share too few shingles with all
others of the open buckets are left out of this, as are pairs whose common
parts are too small; all these bounds are exact. A link counts only after the full
sets confirm it. Buckets with still more components are crowds of texts that share
a passage; the members of all crowds are hashed again with a fresh permutation
into more and stricter bands and compared with more centres, level by level,
until no crowd is left. So no bucket is capped, and none emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawspark.llm import text as T
from lawspark.llm.components import components
from lawspark.session import written

BINS, ROWS = 128, 4  # 32 bands of 4 bins: at similarity 0.8 a pair misses all with 5e-8
CROWD_BINS, CROWD_ROWS = 512, 8  # for crowds, 64 bands of 8 bins: with 8e-6
RUN = 1024  # texts signed at once
CENTRES, GROWTH = 16, 128  # centres of a bucket, times this at each further level
PARTS = 128  # parts of the hash range in which a set's members are counted
_PART = np.uint64(64 - 7)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of minima per sorted, non-empty set of hashes; ``bins`` is a power of two."""
    shift, own = np.uint64(65 - bins.bit_length()), np.arange(bins, dtype=np.uint64)
    edge = own << shift
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, h in enumerate(sets):
        at = np.searchsorted(h, edge)
        found = h[np.minimum(at, len(h) - 1)]
        full[i] = (at < len(h)) & ((found >> shift) == own)
        out[i] = found
    open_ = np.flatnonzero(~full.all(axis=1))
    filled = full[open_].copy()
    rng = np.random.default_rng(7)
    for _ in range(32 * bins):
        probe = rng.integers(0, bins, bins)
        if not len(open_):
            break
        take = ~filled & full[open_][:, probe]
        r, c = np.nonzero(take)
        out[open_[r], c] = out[open_[r], probe[c]]
        filled |= take
        more = ~filled.all(axis=1)
        open_, filled = open_[more], filled[more]
    for i in open_:  # probes used up: practically never
        out[i, ~full[i]] = out[i, np.flatnonzero(full[i])[0]]
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The bucket of each band, as int64."""
    n = signature.shape[1] // rows
    acc = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(signature), n), np.uint64)
    for r in range(rows):
        acc = T.mix(acc + signature[:, r::rows][:, :n] * np.uint64(0xD6E8FEB86659FD93))
    return acc.view(np.int64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one shingle if it has fewer than k words."""
    data, offsets = T.utf8(column)
    for i, j in T.slices(offsets):
        w = T.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], T.NOT_SPACE)
        h = T.hashes(w)
        shingle, doc = T.ngrams(h, w.doc, k)
        count = w.counts()
        at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=j - i))])
        word_at = np.concatenate([[0], np.cumsum(count)])
        for d in range(j - i):
            if 0 < count[d] < k:
                own = h[word_at[d] : word_at[d + 1]]
                yield T.ngrams(own, np.zeros(len(own), np.int64), len(own))[0]
            else:
                yield np.unique(shingle[at[d] : at[d + 1]])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short runs of the batches, so that few sets are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, RUN):
            yield b.slice(at, RUN)


def _list_array(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel()))


def _sign(k: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            sets = list(shingle_sets(b.column("text"), k))
            some = np.array([len(s) > 0 for s in sets], bool)
            key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            size = np.array([len(s) for s in sets], np.int64)
            rows = np.zeros((len(sets), BINS // ROWS), np.int64)
            if some.any():
                rows[some] = bands(signatures([s for s in sets if len(s)]))
            yield pa.record_batch(
                [*(b.column(c) for c in carry), b.column("doc_id"), b.column("h"), b.column("g"), pa.array(key, pa.binary()), pa.array(size), _list_array(rows)],
                names=[*carry, "doc_id", "h", "g", "key", "n_shingles", "bands"],
            )

    return run


def _sets(k: int):
    """Sets of the nodes' sample rows: those whose text still has the node's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _runs(batches):
            node, key, out = b.column("node").to_pylist(), b.column("key").to_pylist(), []
            for i, s in enumerate(shingle_sets(b.column("text"), k)):
                if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key[i]:
                    parts = np.bincount((s >> _PART).astype(np.int64), minlength=PARTS)
                    out.append((node[i], s.view(np.int64), parts.astype(np.int32)))
            node, items, parts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch(
                [pa.array(node, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))],
                names=["node", "items", "parts"],
            )

    return run


def _resign(level: int):
    """Fresh bands of known sets, one permutation per level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for b in _runs(batches):
            items = b.column("items")
            cut = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
            flat = T.mix(items.flatten().to_numpy().view(np.uint64) ^ salt)
            sets = [np.sort(flat[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            rows = np.zeros((0, CROWD_BINS // CROWD_ROWS), np.int64)
            if sets:
                rows = bands(signatures(sets, CROWD_BINS), CROWD_ROWS)
            yield pa.record_batch([b.column("node"), _list_array(rows)], names=["node", "bands"])

    return run


def _shared(rows: DataFrame) -> DataFrame:
    """``bucket, node, centre`` of buckets with several members; the smallest is the centre."""
    buckets = (
        rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
        .where("centre < last").drop("last")
    )
    return rows.join(buckets, "bucket")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets confirm 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("s"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("t"))
    n, m = F.size("s"), F.size("t")
    near = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    return (
        pairs.join(a, "a").join(b, "b").where(near)
        .where(100 * both >= percent * (n + m - both)).select("a", "b").distinct()
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id, component, kept`` per row of ``docs(doc_id, text)``.

    Further narrow columns named in ``carry`` come along.

    Words are runs of non-white-space with A-Z lower-cased; texts of the same
    shingle set are one node. ``component_id`` is the smallest doc_id of the
    component, ``component`` its internal number. Texts without words are
    linked with nothing: each is its own component, even under a repeated id.
    A null id is never the smallest unless the whole component has no other;
    ``kept`` compares null-safely. Repeated rows share component and ``kept``.
    """
    spark = docs.sparkSession
    plain = F.coalesce("text", F.lit(""))
    docs = docs.select(
        *carry, F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.xxhash64(plain).alias("h"), F.xxhash64(F.lit(1), plain).alias("g"),
    )
    added = StructType.fromDDL("doc_id long, h long, g long, key binary, n_shingles long, bands array<long>")
    schema = StructType([*(docs.schema[c] for c in carry), *added.fields])
    signed = docs.mapInArrow(_sign(k, carry), schema)
    sig = written(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    sample = F.min(F.struct("row", "doc_id", "h", "g")).alias("s")
    nodes = written(
        sig.where("key is not null").groupBy("key")
        .agg(sample, F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
        .select("key", F.col("s.row").alias("node"), "doc_id", "s.h", "s.g", F.col("s.doc_id").alias("id"), "bands"),
        "nodes",
    )
    members = written(
        _shared(nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))), "buckets"
    )
    alike = members.select("node").distinct()
    # The sample row of a node, by id and text: neither null ids nor an id with many texts make more of it.
    asked = nodes.join(alike, "node", "left_semi").select("node", "key", "id", F.col("h").alias("__h"), F.col("g").alias("__g"))
    here = (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")) & F.col("doc_id").eqNullSafe(F.col("id"))
    texts = docs.select("doc_id", "text", "h", "g").join(asked, here).select("node", "key", "text")
    sets = written(texts.mapInArrow(_sets(k), "node long, items array<long>, parts array<int>").dropDuplicates(["node"]), "sets")
    able = written(_common(sets, percent).select("node"), "able")
    members = written(_shared(members.select("node", "bucket").join(able, "node", "left_semi")), "members")

    star = members.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = written(_verified(star.distinct(), sets, percent), "links")
    label = components(links)
    level, wide = 0, CENTRES
    while True:
        # Written, as are the crowds below: each is read twice, and the join with the mixed buckets is made once.
        open_ = _unresolved(members, label).where("centre is null or node > centre").select("bucket", "node", "root")
        open_ = written(_linkable(written(open_, "unresolved"), sets, percent), "open")
        w = Window.partitionBy("bucket").orderBy("node")
        centres = written(
            open_.withColumn("at", F.row_number().over(w)).where(F.col("at") <= wide)
            .select("bucket", F.col("node").alias("a"), F.col("root").alias("of"), F.col("n").alias("m"),
                    F.col("common").alias("shared"), F.col("parts").alias("others"), "at"),
            "centres",
        )
        if centres.isEmpty():
            break
        # Two sets share at most what either has in common with any other, and
        # in each part of the hash range at most the smaller number of members.
        need = percent * (F.col("n") + F.col("m"))
        by_part = F.aggregate(F.zip_with("parts", "others", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        enough = ((100 + percent) * F.least("common", "shared") >= need) & ((100 + percent) * by_part >= need)
        pairs = open_.join(centres, "bucket").where("node > a and root <> of").where(enough)
        pairs = pairs.select("a", F.col("node").alias("b")).distinct()
        links = written(links.unionByName(_verified(pairs, sets, percent)), "links")
        label = components(links)
        full = centres.where(F.col("at") == wide).select("bucket", F.col("a").alias("used"))
        rest = open_.select("bucket", "node").join(full, "bucket")
        crowd = written(_unresolved(rest, label).where("node > used").select("bucket", "node"), "unresolved")
        crowd = written(_shared(crowd).select("node").distinct(), "crowds")
        if crowd.isEmpty():
            break
        level, wide = level + 1, wide * GROWTH
        fresh = sets.join(crowd, "node", "left_semi").mapInArrow(_resign(level), "node long, bands array<long>")
        members = _shared(fresh.select("node", F.explode(F.array_distinct("bands")).alias("bucket")))
        members = written(members.withColumn("centre", F.lit(None).cast("long")), "buckets")
    return _result(sig, nodes, label)


def _linkable(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows whose set can be linked at all, with its size ``n``, its ``common`` part and its ``parts``.

    A shingle that only one of these sets has is in no intersection, so a set
    with too many of its own can have no link among them.
    """
    return open_.join(_common(sets.join(open_.select("node").distinct(), "node", "left_semi"), percent), "node")


def _common(own: DataFrame, percent: int) -> DataFrame:
    """``node, parts, n, common`` of the sets that have enough shingles in common with others of them."""
    alone = (
        own.select("node", F.explode("items").alias("item")).groupBy("item")
        .agg(F.min("node").alias("node"), F.count("*").alias("df")).where("df = 1")
        .groupBy("node").agg(F.count("*").alias("alone"))
    )
    n = F.size("items").cast("long")
    size = own.select("node", "parts", n.alias("n")).join(alone, "node", "left")
    size = size.select("node", "parts", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
    return size.where(100 * F.col("common") >= percent * F.col("n"))


def _unresolved(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members, with their root, of buckets that hold several components."""
    known = members.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = (
        known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high").select("bucket")
    )
    return known.join(mixed, "bucket", "left_semi")


def _result(sig: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    rooted = (
        nodes.select("key", "node", "doc_id").join(label, "node", "left")
        .select("key", "doc_id", F.coalesce("root", "node").alias("component"))
    )
    least = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    owner = rooted.select("key", "component").join(least, "component")
    grouped = sig.drop("bands").join(owner, "key", "left")
    own = F.col("key").isNull()
    out = grouped.select(
        *[c for c in sig.columns if c not in ("key", "bands", "row", "h", "g")],
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(own, F.col("row")).otherwise(F.col("component")).alias("component"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
