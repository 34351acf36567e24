"""Ranked lexical search over bit-sliced Bloom signatures.

``index`` cuts the documents into blocks of similar size. A block's signature
has a bitmap over its documents for each bit position (a slice): a term is
present in a document at most where all its slices are set. Four levels of
slices tell whether a term may occur 1, 2, 4 or 8 times; with the document's
length and its most frequent term's count they bound the term's share of a
score from above. Texts lie in a column of their own, so that a search reads
signatures only.

``search`` counts how many documents hold each asked term (one scan of the
texts), bounds all scores by weighted sums of slices, scores the documents with
the highest bounds exactly, and takes the k-th best score found as the floor: a
document whose bound lies below it is provably no result. All others are scored
exactly on their texts, terms compared byte by byte. Of documents with equal
texts only the k smallest ids can be results, so a text copied without bound is
scored once. All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawspark.llm import text as T
from lawspark.session import written

K = 10
BLOCK, BLOCK_BYTES = 128, 256 << 10  # documents and text of a block at most; a longer text is a block of its own
SLICE = 4 << 20  # bytes of text from which blocks are made
LEVELS = (1, 2, 4, 8)
HASHES, BITS = 3, 12  # slices of a term, slices per distinct term of the block's longest document
QUERY_BYTES = 1 << 20  # query texts searched in one pass: bounds what is broadcast
_STEP = 0x9E3779B97F4A7C15


def _slots(h: np.ndarray, level: int, rows: int) -> np.ndarray:
    """``HASHES`` slices of each hash."""
    salts = np.array([(level * HASHES + j + 1) * _STEP & (1 << 64) - 1 for j in range(HASHES)], np.uint64)
    return (T.mix(h[:, None] ^ salts) % np.uint64(rows)).astype(np.int64)


def _power(n: int) -> int:
    return 1 << max(6, int(n - 1).bit_length())


def _blocks(doc: np.ndarray, h: np.ndarray, tf: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, list[int], bytes]]:
    """Documents, slices of each level and packed slices of each block; ``text`` is how long each document is."""
    n_docs = len(text)
    distinct = np.bincount(doc, minlength=n_docs)
    kind = np.ceil(np.log2(np.maximum(distinct, 8))).astype(int)
    for size in np.unique(kind):
        members = np.flatnonzero(kind == size)
        # A document counts as much as fills the block by number or by text.
        room = np.maximum(text[members], BLOCK_BYTES // BLOCK)
        for start, end in T.slices(np.append(0, np.cumsum(room)), BLOCK_BYTES):
            own = members[start:end]
            column = np.full(n_docs, -1)
            column[own] = np.arange(len(own))
            mine = column[doc] >= 0
            rows, packed = [], []
            for level, least in enumerate(LEVELS):
                some = mine & (tf >= least)
                col = column[doc[some]]
                n = _power(BITS * int(np.bincount(col, minlength=1).max(initial=0)))
                bits = np.zeros((n, len(own)), bool)
                bits[_slots(h[some], level, n).ravel(), np.repeat(col, HASHES)] = True
                rows.append(n)
                packed.append(np.packbits(bits.ravel()).tobytes())
            yield own, rows, b"".join(packed)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct term, and the number of terms of each document."""
    w = T.words(data, offsets, T.ALNUM)
    h = T.hashes(w)
    order = np.lexsort((h, w.doc))
    doc, h = w.doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h))), w.counts()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column("text").cast(pa.large_string()).fill_null("")
        data, offsets = T.utf8(column)
        for i, j in T.slices(offsets, SLICE):
            # Terms are counted in shorter runs than blocks are made of: words take more room than their counts.
            parts = []
            for s, e in T.slices(offsets[i : j + 1]):
                doc, h, tf, n = _counted(data[offsets[i + s] : offsets[i + e]], offsets[i + s : i + e + 1] - offsets[i + s])
                parts.append((doc + s, h, tf, n))
            doc, h, tf, length = (np.concatenate(x) for x in zip(*parts, strict=True))
            peak = np.zeros(j - i, np.int64)
            np.maximum.at(peak, doc, tf)
            cut = offsets[i : j + 1].tolist()
            key = np.array([xxhash.xxh3_128_digest(data[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)], object)
            for own, rows, packed in _blocks(doc, h, tf, np.diff(offsets[i : j + 1])):
                at = pa.array(i + own)

                def lists(values: pa.Array, kind: pa.DataType) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))

                yield pa.record_batch(
                    [
                        lists(b.column("doc_id").take(at), pa.int64()), lists(pa.array(length[own]), pa.int64()),
                        lists(pa.array(peak[own]), pa.int64()), lists(pa.array(key[own].tolist(), pa.binary()), pa.binary()),
                        pa.array([rows], pa.list_(pa.int32())), pa.array([packed], pa.binary()),
                        lists(column.take(at), pa.string()),
                    ],
                    names=["doc_ids", "lengths", "peaks", "keys", "slices", "bits", "texts"],
                )


def index(docs: DataFrame) -> DataFrame:
    """The signatures of ``docs(doc_id, text)``, a written table of one row a block.

    A null or empty text has no terms. Ids may be null or repeated.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _index,
        "doc_ids array<long>, lengths array<long>, peaks array<long>, keys array<binary>, "
        "slices array<int>, bits binary, texts array<string>",
    )
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "signatures")


@dataclass(frozen=True)
class Asked:
    """Terms of a block of queries, sorted by hash, and where they occur in the items."""

    items: np.ndarray  # numbers of the items, ascending
    hash: np.ndarray
    data: np.ndarray  # bytes of all terms
    start: np.ndarray
    size: np.ndarray
    begin: np.ndarray  # first occurrence of each item
    term: np.ndarray  # of each occurrence
    times: np.ndarray  # how often the item repeats it
    weight: np.ndarray | None = None  # of each term
    docs: int = 0
    words: int = 0
    floor: np.ndarray | None = None  # of each item

    def by_term(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item of each occurrence; where each term's occurrences begin, and they by term."""
        item_of = np.searchsorted(self.begin, np.arange(len(self.term)), "right") - 1
        order = np.argsort(self.term, kind="stable")
        return item_of, np.searchsorted(self.term[order], np.arange(len(self.hash) + 1)), order


def _asked(rows: pa.Table) -> Asked:
    """``rows(item, text)`` as terms."""
    rows = rows.sort_by("item")
    data, offsets = T.utf8(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    w = T.words(data, offsets, T.ALNUM)
    low = T.LOWER[data].tobytes()
    words = [low[a:z] for a, z in zip(w.start, w.end, strict=True)]
    h = T.hashes(w)
    terms = sorted(set(zip(h.tolist(), words, strict=True)))
    place = {t: i for i, t in enumerate(terms)}
    occurs: dict[tuple[int, int], int] = {}
    for item, pair in zip(w.doc.tolist(), zip(h.tolist(), words, strict=True), strict=True):
        occurs[item, place[pair]] = occurs.get((item, place[pair]), 0) + 1
    keys = sorted(occurs)
    size = np.array([len(t) for _, t in terms], np.int64)
    at = np.array([k[0] for k in keys], np.int64)
    return Asked(
        rows.column("item").to_numpy(), np.array([x for x, _ in terms], np.uint64),
        np.frombuffer(b"".join(t for _, t in terms), np.uint8), np.cumsum(size) - size, size,
        np.searchsorted(at, np.arange(rows.num_rows)), np.array([k[1] for k in keys], np.int64),
        np.array([occurs[k] for k in keys], np.int64),
    )


def hits(texts: pa.Array, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``document, term, times`` of the asked terms, exactly, and the number of words of each document."""
    data, offsets = T.utf8(texts)
    found, n_terms = [], len(asked.hash)
    n_words = np.zeros(len(texts), np.int64)
    for i, j in T.slices(offsets):
        w = T.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], T.ALNUM)
        n_words[i:j] = w.counts()
        h = T.hashes(w)
        at, step = np.searchsorted(asked.hash, h), 0
        while n_terms:  # more than one round only if two terms share a hash
            term = at + step
            same = (term < n_terms) & (asked.hash[np.minimum(term, n_terms - 1)] == h)
            if not same.any():
                break
            who, term = np.flatnonzero(same), term[same]
            equal = (w.end - w.start)[who] == asked.size[term]
            who, term = who[equal], term[equal]
            size = asked.size[term]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            alike = T.LOWER[w.data[np.repeat(w.start[who], size) + inner]] == asked.data[np.repeat(asked.start[term], size) + inner]
            if len(who):
                good = np.logical_and.reduceat(alike, np.cumsum(size) - size)
                found.append((i + w.doc[who[good]]) * n_terms + term[good])
            step += 1
    code, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return code // max(1, n_terms), code % max(1, n_terms), times, n_words


def share(tf: np.ndarray, n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """The integer share of a term that occurs ``tf`` times in a document of ``n`` terms."""
    m = 100 - 75 + (75 * n * docs) // max(1, words)
    return np.where(tf > 0, (1_000_000_000 * tf) // (1000 * tf + 8 * m), 0)


def _flat(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten()


def _count(shipped):
    """How many documents of a task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        df = np.zeros(len(asked.hash), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                _, term, _, _ = hits(_flat(b.column("texts").slice(r, 1)), asked)
                df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


def bounds(slices: list[int], packed: bytes, n: np.ndarray, peak: np.ndarray, asked: Asked) -> np.ndarray:
    """Upper bounds of the scores: a row for each item, a column for each document."""
    width, items = len(n), len(asked.items)
    out, raw, at, last = np.zeros(items * width, np.int64), np.frombuffer(packed, np.uint8), 0, 0
    item_of, first, order = asked.by_term()
    term = col = np.zeros(0, np.int64)
    for level, rows in enumerate(slices):
        size = -(-rows * width // 8)
        bits = np.unpackbits(raw[at : at + size], count=rows * width).reshape(rows, width)
        at += size
        slot = _slots(asked.hash, level, rows)
        if level == 0:
            here = bits[slot[:, 0]]
            for j in range(1, HASHES):
                here &= bits[slot[:, j]]
            term, col = np.nonzero(here)
        else:  # where the term may occur at all
            for j in range(HASHES):
                here = bits[slot[term, j], col] > 0
                term, col = term[here], col[here]
        most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else peak
        more = share(np.minimum(peak, most), n, asked.docs, asked.words)
        count = first[term + 1] - first[term]
        occurs = order[np.repeat(first[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        value = asked.times[occurs] * asked.weight[asked.term[occurs]]
        cell = item_of[occurs] * width + np.repeat(col, count)
        sums = np.bincount(cell, value, items * width).astype(np.int64)  # whole numbers far below 2^53
        out += sums * np.tile(more - last, items)
        last = more
    return out.reshape(items, width)


def _bounded(shipped, keep: int | None):
    """Documents that can be results; with ``keep`` those with the highest bounds of each task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        floor = np.maximum(asked.floor, 1) if asked.floor is not None else np.ones(len(asked.items), np.int64)
        best = np.zeros((len(asked.items), keep or 1), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                lists = [_flat(b.column(c).slice(r, 1)) for c in ("doc_ids", "lengths", "peaks", "keys", "slices")]
                ids, n, peak, key, slices = lists
                ub = bounds(slices.to_pylist(), b.column("bits")[r].as_py(), n.to_numpy(), peak.to_numpy(), asked)
                if keep:
                    both = np.concatenate([best, ub], axis=1)
                    best = np.partition(both, both.shape[1] - keep, axis=1)[:, -keep:]
                    floor = np.maximum(1, best.min(axis=1))
                item, pos = np.nonzero(ub >= floor[:, None])
                if not len(item):
                    continue
                at = pa.array(pos)
                yield pa.record_batch(
                    [pa.array(asked.items[item]), pa.array(np.full(len(item), b.column("block")[r].as_py())),
                     pa.array(pos.astype(np.int32)), pa.array(ub[item, pos]), ids.take(at), key.take(at)],
                    names=["item", "block", "pos", "bound", "doc_id", "key"],
                )

    return run


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        item_of, first, order = asked.by_term()
        for b in batches:
            for r in range(b.num_rows):
                wanted = _flat(b.column("wanted").slice(r, 1))
                pos, item = (wanted.field(c).to_numpy() for c in ("pos", "item"))
                rows, at = np.unique(pos, return_inverse=True)
                doc, term, tf, n = hits(_flat(b.column("texts").slice(r, 1)).take(pa.array(rows)), asked)
                value = asked.weight[term] * share(tf, n[doc], asked.docs, asked.words)
                count = first[term + 1] - first[term]
                each = np.repeat(first[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                occurs = order[each]
                total = np.zeros((len(rows), len(asked.items)), np.int64)
                np.add.at(total, (np.repeat(doc, count), item_of[occurs]), np.repeat(value, count) * asked.times[occurs])
                score = total[at, np.searchsorted(asked.items, item)]
                yield pa.record_batch(
                    [pa.array(item), pa.array(np.full(len(item), b.column("block")[r].as_py())), pa.array(pos), pa.array(score)],
                    names=["item", "block", "pos", "score"],
                )

    return run


def _exact(stored: DataFrame, wanted: DataFrame, shipped) -> DataFrame:
    """``item, block, pos, score`` of the wanted places, on the texts of their blocks."""
    listed = wanted.groupBy("block").agg(F.collect_list(F.struct("pos", "item")).alias("wanted"))
    rows = stored.select("block", "texts").join(listed, "block")
    return rows.mapInArrow(_score(shipped), "item long, block long, pos int, score long")


def _found(stored: DataFrame, asked: Asked, k: int) -> DataFrame:
    spark = stored.sparkSession
    sc = spark.sparkContext
    n = stored.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    docs, words = n["docs"], n["words"] or 0
    counted = stored.select("texts").mapInArrow(_count(sc.broadcast(asked)), "term long, df long")
    df = np.zeros(len(asked.hash), np.int64)
    for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect():  # the asked terms: bounded
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    asked = replace(asked, weight=weight, docs=docs, words=words)

    signed = stored.drop("texts")
    schema = "item long, block long, pos int, bound long, doc_id long, key binary"
    first = Window.partitionBy("item").orderBy(F.desc("bound"), "block", "pos")
    seeds = signed.mapInArrow(_bounded(sc.broadcast(asked), k), schema)
    seeds = written(seeds.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r"), "seeds")
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    scored = _exact(stored, seeds, sc.broadcast(asked)).withColumn("r", F.row_number().over(best))
    floor = np.zeros(len(asked.items), np.int64)
    for r in scored.where(F.col("r") == k).select("item", "score").collect():  # one row an item
        floor[np.searchsorted(asked.items, r["item"])] = r["score"]
    shipped = sc.broadcast(replace(asked, floor=floor))

    by_id = Window.partitionBy("item", "key").orderBy(F.asc_nulls_last("doc_id"), "block", "pos")
    open_ = signed.mapInArrow(_bounded(shipped, None), schema).withColumn("r", F.row_number().over(by_id))
    open_ = written(open_.where(F.col("r") <= k), "open")
    scores = _exact(stored, open_.where("r = 1"), shipped)
    keys = open_.where("r = 1").select("item", "block", "pos", "key")
    scores = scores.where("score > 0").join(keys, ["item", "block", "pos"]).select("item", "key", "score")
    ranks = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        open_.select("item", "key", "doc_id").join(scores, ["item", "key"])
        .withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")
    )


def search(stored: DataFrame, items: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score above 0 of each of ``items(item_id, text)``.

    Equal scores go by ascending doc_id, null ids last. Items without terms
    find nothing; rows equal in id and text are one item, other rows of one id
    are ranked each. Queries come in blocks of about ``query_bytes`` of text.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // query_bytes))
    out = None
    for i in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        found = _found(stored, _asked(part.select("item", "text").toArrow()), k)
        found = written(found, "found") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
