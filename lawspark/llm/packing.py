"""Packing of tokenised documents into sequences of a fixed length.

``tokenise`` turns documents into pieces: all ids of a document, closed by an
end id and cut every ``length`` ids. Each piece keeps its ids as little-endian
unsigned 32-bit integers, in one table. ``place`` packs the pieces: they were
dealt at random into groups of about ``group`` pieces, and in each group first
fit decreasing puts every piece into the first sequence with room, which a
tournament tree over the sequences' free places finds in logarithmic time.
Groups are independent, so packing is one narrow shuffle without ids.
``sequences`` joins the ids to their places.

The tokenizer is asked once per distinct word of a batch. Words are cut at
ASCII white space and, in plain ASCII words, where letters, digits and other
signs meet, which are borders for the tokenizer too; words with an apostrophe,
``<`` or a non-ASCII letter stay whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawspark.llm import text as T
from lawspark.session import scratch_dir

LENGTH = 4096
END = 2
GROUP = 4096
CACHE = 150_000  # words kept per Python worker
RUN = 3 << 20  # bytes of text tokenised at once: words that recur in a run are looked up once
CALL = 4096  # words tokenised in one call

# 0 white space, 1 letter, 2 digit, 3 other sign, 4 non-ASCII
_CLASS = np.full(256, 3, np.uint8)
_CLASS[~T.NOT_SPACE] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x80:] = 4
_WHOLE = np.zeros(256, bool)  # a word with one of these stays whole
_WHOLE[0x80:] = True
_WHOLE[[ord("'"), ord("<")]] = True

_LATIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")  # lower case; no ' and no <
# Byte-level vocabularies write a byte as the character of its number if that is printable, else from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


class WordTokenizer:
    """Token ids of texts, through a cache of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        # Plain words skip the tokenizer's text steps, if these leave such words alone.
        probe = ["a", "hello", "packing", "7", "!?", "--", "zzqx"]
        accents = "".join(map(_BYTES.__getitem__, "été".encode()))
        self.direct = all(self._plain(w) == tuple(self._full([w])[0].ids) for w in probe)
        self.direct &= self._plain(accents) == tuple(self._full(["été"])[0].ids)
        self.known: dict[str, tuple[int, ...]] = {}
        self.often: set[str] = set()  # words met in more than one run

    def _plain(self, word: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.encoder.model.tokenize(word)])

    def _full(self, words: list[str]):
        return self.encoder.encode_batch(words, add_special_tokens=False)

    def _ids(self, vocabulary: list[str]) -> list[tuple[int, ...]]:
        new = [w for w in vocabulary if w not in self.known]
        self.often.update(w for w in vocabulary if w in self.known)
        if len(self.known) + len(new) > CACHE:
            kept = self.often if len(self.often) < CACHE // 2 else ()
            self.known = {w: self.known[w] for w in kept}
            self.often = set()
            new = [w for w in vocabulary if w not in self.known]
        if self.direct:
            # Cut, lower-cased and printable ASCII: one word to the tokenizer, each byte its own sign.
            plain = [w for w in new if w.isascii() and w.isprintable() and "'" not in w and "<" not in w]
            self.known.update((w, self._plain(w)) for w in plain)
            for w in new:  # letters of Latin alphabets, then signs: a word of bytes, and one of signs
                m = None if w.isascii() else _LATIN.fullmatch(w.lower())
                if m:
                    letters = "".join(map(_BYTES.__getitem__, m[1].encode()))
                    self.known[w] = self._plain(letters) + (self._plain(m[2]) if m[2] else ())
            new = [w for w in new if w not in self.known]
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            self.known.update((w, tuple(e.ids)) for w, e in zip(part, self._full(part), strict=True))
        return [self.known[w] for w in vocabulary]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, and the offsets of each text."""
        n = len(offsets) - 1
        w = T.words(data, offsets, T.NOT_SPACE)
        if not len(w.start):
            return np.full(n, end, np.uint32), np.arange(n + 1)
        at, doc = self._cut(w)
        low = data.copy()
        kept = T.NOT_SPACE[data]
        marked = np.zeros(len(data) + 1, np.int64)  # words with "<" keep their case: special tokens
        bracket = np.logical_or.reduceat(data == ord("<"), w.start)
        marked[w.start[bracket]] += 1
        marked[w.end[bracket]] -= 1
        plain = np.cumsum(marked[:-1]) == 0
        low[plain] = T.LOWER[data[plain]]
        packed = low[kept]
        place = np.cumsum(kept) - 1
        bounds = np.concatenate([place[at], [len(packed)]]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(packed.tobytes()))
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy()
        ids = self._ids(coded.dictionary.to_pylist())
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        count = size[code]
        per_doc = np.bincount(doc, weights=count, minlength=n).astype(np.int64) + 1
        to = np.concatenate([[0], np.cumsum(per_doc)])
        out = np.full(to[-1], end, np.uint32)
        total = int(count.sum())
        every = np.arange(total)
        out[every + np.repeat(doc, count)] = flat[every + np.repeat(first[code] - (np.cumsum(count) - count), count)]
        return out, to

    @staticmethod
    def _cut(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Start and text of each part of the words."""
        c = _CLASS[w.data]
        border = np.zeros(len(c), bool)
        border[1:] = (c[1:] != c[:-1]) | (c[1:] == 2)
        border &= c > 0
        whole = np.logical_or.reduceat(_WHOLE[w.data], w.start)  # up to the next word: only spaces follow
        step = np.zeros(len(c) + 1, np.int64)
        step[w.start[whole]] += 1  # starts differ from each other, and so do ends
        step[w.end[whole]] -= 1
        border &= np.cumsum(step[:-1]) == 0
        border[w.start] = True
        at = np.flatnonzero(border)
        return at, w.doc[np.searchsorted(w.start, at, "right") - 1]


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One per Python worker: it outlives the task, and so do the words it knows."""
    return WordTokenizer(path)


def _pieces(path: str, length: int, end: int, seed: int, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        rng = np.random.default_rng([seed, task.partitionId() if task else 0])
        tokenizer = _tokenizer(path)
        for b in batches:
            data, offsets = T.utf8(b.column("text"))
            for i, j in T.slices(offsets, run_bytes):
                ids, to = tokenizer.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                whole = np.diff(to)
                n = -(-whole // length)
                doc = np.repeat(np.arange(j - i), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(length, whole[doc] - start)
                cut = np.concatenate([[0], np.cumsum(size)]) * 4
                raw = pa.py_buffer(ids.astype("<u4").tobytes())
                yield pa.record_batch(
                    [
                        b.column("doc_id").slice(i, j - i).take(pa.array(doc)),
                        pa.array(start), pa.array(size), pa.array(whole[doc]),
                        pa.array(rng.integers(0, 1 << 62, len(doc))),
                        pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), len(doc), [None, pa.py_buffer(cut.astype(np.int64)), raw]
                        ).cast(pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "deal", "ids"],
                )

    return run


def tokenise(
    docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, seed: int = 1, run_bytes: int = RUN
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, deal, ids, piece`` of ``docs(doc_id, text)``, as a written table.

    A null or empty text is its end id alone; repeated rows are packed each;
    ids may be null. ``run_bytes`` of text are tokenised at once: more take less
    time and more memory, which a worker keeps. ``deal`` is the random number that groups the piece,
    drawn once, as the rows are written.
    """
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, doc_tokens long, deal long, ids binary"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(tokenizer_path, length, end, seed, run_bytes), schema
    )
    path = scratch_dir(spark, "pieces")
    rows.withColumn("piece", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; bins by a tournament tree of free places."""
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def place(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The given narrow ``pieces(length, deal, …)`` with ``sequence_id`` and ``offset``."""
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("deal", F.pmod("deal", F.lit(groups)))
    out = [c for c in pieces.columns if c != "deal"]
    schema = pieces.select(*out).schema.add("sequence_id", "long").add("offset", "long")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        at = int(rows["deal"].iloc[0])
        return rows[out].assign(sequence_id=bins * groups + at, offset=offsets)

    return dealt.groupBy("deal").applyInPandas(run, schema)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the packed sequences themselves."""
    rows = placed.select("piece", "sequence_id", "offset", "length").join(pieces.select("piece", "ids"), "piece")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one sequence's ids
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids")
    )
