"""Alignment of two tokenizers: links between tokens that end at the same byte.

``encode`` tokenises each document twice in one scan and writes a row per
document and, for every few megabytes of text, *runs* of ``(pair, document,
times)`` records: sorted by pair, side B first, cut by B's id into ``RADIX``
partitions and packed as zstd frames of bounded size. A pair has one record a
document, however often the document links it.

``pair_counts`` merges runs of a partition, ``FAN_IN`` at a time and level by
level, with a heap over their frames, so that no task holds more than one frame
of each; a pair that stands in every document is one record a run after the
first level. The last merge passes the pairs in B's order and marks, as soon as
the B id is complete, those with its highest count. ``contributions`` streams
the marked pairs back against the runs and sums per document.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawspark.llm import text as T
from lawspark.session import written

RADIX = 16
RUN_BYTES = 4 << 20  # text of a run; a longer document is a run of its own
FRAME = 1 << 16  # records of a frame
FAN_IN = 64  # runs merged at once, about
CALL_BYTES = 1 << 20  # text tokenised at once

# Fixed value: how byte-level vocabularies cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(_HIDDEN)}


@dataclass(frozen=True)
class Vocabulary:
    """Bytes and decimal number of each token id."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Vocabulary:
        size = np.array([len(t) for t in tokens], np.int64)
        return Vocabulary(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class ByteLevel:
    """Ids of a byte-level BPE file, special tokens read as plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        own = {t: i for t, i in vocab.items() if t not in special}
        self.size = max([*vocab.values(), *special.values()]) + 1
        tokens = [b""] * self.size
        for t, i in own.items():
            tokens[i] = bytes(_BYTE_OF[c] for c in t)
        self.vocabulary = Vocabulary.of(tokens)
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        # Where ids follow the order of merges, the faster library gives the same ids.
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in merges]
        plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.fast = None
        if plain and all(x < y for x, y in zip(made, made[1:], strict=False)) and min(made, default=0) >= 256:
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for i in own.values()}, special_tokens={})
            probe = " Hello wörld's 123\n\n  ?! <|endoftext|>　x"
            if self.fast.encode_ordinary(probe) != self.full.encode(probe, add_special_tokens=False).ids:
                self.fast = None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            return np.asarray(self.fast.encode_ordinary(text), np.int64)
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Ids of a sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        tokens = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.vocabulary = Vocabulary.of(tokens)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """One pair per Python worker."""
    return ByteLevel(a_path), Pieces(b_path)


@lru_cache(maxsize=4)
def _decimals(n: int, after: str) -> Vocabulary:
    return Vocabulary.of([f"{i}{after}".encode() for i in range(n)])


@lru_cache(maxsize=2)
def _radix_order(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B's ids in the order of the partitions: place of each id, and first place of each partition."""
    radix = (T.mix(np.arange(n, dtype=np.uint64)) % np.uint64(RADIX)).astype(np.int64)
    order = np.argsort(radix, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, np.searchsorted(radix[order], np.arange(RADIX + 1))


# --- frames -----------------------------------------------------------------

def _planes(x: np.ndarray) -> bytes:
    """Bytes of one order of magnitude together, which packs better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def pack(*columns: np.ndarray) -> list[bytes]:
    """Frames of uint64 columns; the first, sorted one is kept as differences."""
    packer, out = zstandard.ZstdCompressor(level=1), []
    for at in range(0, len(columns[0]), FRAME):
        part = [c[at : at + FRAME].astype("<u8") for c in columns]
        part[0] = np.diff(part[0], prepend=np.uint64(0))
        out.append(packer.compress(np.array([len(part), len(part[0])], "<u4").tobytes() + b"".join(map(_planes, part))))
    return out


def unpack(frame: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    k, n = np.frombuffer(raw, "<u4", 2)
    flat = np.frombuffer(raw, np.uint8, offset=8).reshape(k, 8, n)
    out = [np.ascontiguousarray(c.T).view("<u8").ravel() for c in flat]
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def merge(runs: list[list[bytes]], weigh) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``pair, count`` blocks of all runs in order, by a heap over the runs' current frames.

    ``weigh`` turns the columns of a frame into pairs and counts.
    """
    heap: list[tuple[int, int]] = []
    rest, now = [iter(r) for r in runs], {}

    def load(i: int) -> None:
        frame = next(rest[i], None)
        if frame is None:
            now.pop(i, None)
        else:
            now[i] = weigh(*unpack(frame))
            heapq.heappush(heap, (int(now[i][0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        limit, done = heap[0][0], []
        while heap and heap[0][0] == limit:  # all frames that end here
            done.append(heapq.heappop(heap)[1])
        parts = []
        for i, (pair, count) in now.items():
            cut = np.searchsorted(pair, limit, "right")
            if cut:
                parts.append((pair[:cut], count[:cut]))
                now[i] = (pair[cut:], count[cut:])
        for i in done:
            load(i)
            # The next frame may begin with the same pair; it then counts as well.
            while i in now and now[i][0][0] == limit:
                same = np.searchsorted(now[i][0], limit, "right")
                parts.append((now[i][0][:same], now[i][1][:same]))
                now[i] = (now[i][0][same:], now[i][1][same:])
                if len(now[i][0]):
                    break
                heap.remove((limit, i))
                heapq.heapify(heap)
                load(i)
        pair, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, count = pair[order], count[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        yield pair[first], np.add.reduceat(count, first)


# --- tokenising -------------------------------------------------------------

@dataclass
class _Doc:
    doc_id: int | None
    a: np.ndarray
    b: np.ndarray


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _aligned(docs: list[_Doc], va: Vocabulary, vb: Vocabulary):
    """Per document groups, links and digest; all links as document, A id, B id."""
    n = len(docs)
    na, nb = (np.array([len(x) for x in side], np.int64) for side in ([d.a for d in docs], [d.b for d in docs]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in ([d.a for d in docs], [d.b for d in docs]))
    doc_a, doc_b = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
    end_a, end_b = np.cumsum(va.size[a]), np.cumsum(vb.size[b])  # texts of both sides are the same, so ends are comparable
    low, high = np.searchsorted(end_b, end_a), np.searchsorted(end_b, end_a, "right")
    times = high - low
    left = np.repeat(np.arange(len(a)), times)
    right = np.repeat(low - _starts(times), times) + np.arange(times.sum())
    cut = np.unique(end_a[times > 0])
    group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
    last = np.searchsorted(end_a, cut, "right") - 1
    n_groups = np.bincount(doc_a[last], minlength=n)
    n_links = np.bincount(doc_a[left], minlength=n)
    # The digest's text: A's tokens of a group, then B's; what follows a token depends on its place.
    per_a, per_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
    place = np.concatenate([np.arange(len(a)) + _starts(per_b)[group_a], np.arange(len(b)) + np.cumsum(per_a)[group_b]])
    top = max(len(va.size), len(vb.size))
    numbers = _decimals(top, ",")
    final = np.concatenate([np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]])
    ids, mark = np.empty(len(place), np.int64), np.full(len(place), ord(","), np.uint8)
    ids[place] = np.concatenate([a, b])
    ends = np.concatenate([np.full(len(a), ord("|"), np.uint8), np.full(len(b), ord(";"), np.uint8)])
    mark[place[final]] = ends[final]
    text, size = numbers.join(ids), numbers.size[ids]
    text[np.cumsum(size) - 1] = mark
    at = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(na + nb))]
    raw = text.tobytes()
    digest = [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return na, nb, n_groups, n_links, digest, (doc_a[left], a[left], b[right])


def _encode(a_path: str, b_path: str):
    doc_names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        ta, tb = _tokenizers(a_path, b_path)
        va, vb = ta.vocabulary, tb.vocabulary
        place, first = _radix_order(tb.size)
        bits_a = int(ta.size).bit_length()
        row, held, links, size = base, 0, [], 0

        def runs() -> pa.RecordBatch:
            """All links since the last run, sorted and packed."""
            nonlocal links, held, size
            doc, a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            bits = max(1, int(held).bit_length())
            key = ((place[b].astype(np.uint64) << np.uint64(bits_a)) | a.astype(np.uint64)) << np.uint64(bits) | doc.astype(np.uint64)
            key, times = np.unique(key, return_counts=True)
            pair = key >> np.uint64(bits)
            doc = (key & np.uint64((1 << bits) - 1)) + np.uint64(row - held)
            at = np.searchsorted(pair, first.astype(np.uint64) << np.uint64(bits_a))
            radix, frames = [], []
            for r in range(RADIX):
                s, e = at[r], at[r + 1]
                if s < e:
                    radix.append(r)
                    frames.append(pack(pair[s:e], doc[s:e], times[s:e]))
            links, size, held = [], 0, 0
            return pa.record_batch(
                [pa.nulls(len(radix), pa.int64())] * 6 + [pa.nulls(len(radix), pa.string()), pa.array(radix, pa.int32()),
                 pa.array(np.full(len(radix), row)), pa.array(frames, pa.list_(pa.binary()))],
                names=[*doc_names, "radix", "run", "frames"],
            )

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            text = batch.column("text").cast(pa.large_string()).fill_null("")
            _, offsets = T.utf8(text)
            for i, j in T.slices(offsets, CALL_BYTES):
                texts = text.slice(i, j - i).to_pylist()
                docs, none = [], np.zeros(0, np.int64)
                for doc_id, t, b in zip(ids[i:j], texts, tb.encode(texts), strict=True):
                    a = ta.encode(" " + t) if t else none
                    raw = (" " + t).encode()
                    same = bool(t) and va.join(a).tobytes() == raw and vb.join(b).tobytes() == raw
                    docs.append(_Doc(doc_id, a, b) if same else _Doc(doc_id, none, none))
                na, nb, n_groups, n_links, digest, (doc, a, b) = _aligned(docs, va, vb)
                n = len(docs)
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + n)), pa.array([d.doc_id for d in docs], pa.int64()), pa.array(na), pa.array(nb),
                     pa.array(n_groups), pa.array(n_links), pa.array(digest, pa.string()), pa.nulls(n, pa.int32()),
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.binary()))],
                    names=[*doc_names, "radix", "run", "frames"],
                )
                links.append((held + doc, a, b))
                held, row, size = held + n, row + n, size + int(offsets[j] - offsets[i])
                if size >= RUN_BYTES:
                    yield runs()
        if links:
            yield runs()

    return run


def encode(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (``radix`` null) and runs of their links, as a written table.

    ``docs(doc_id, text)``; ``a_path`` is a byte-level BPE file, ``b_path`` a
    sentencepiece model; both read a space before the text. A text that is
    null, empty or not restored by both tokenizers has no tokens. Ids may be
    null or repeated: rows are told apart by ``row``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _encode(a_path, b_path),
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "radix int, run long, frames array<binary>",
    )
    return written(rows, "encoded")


# --- counting ---------------------------------------------------------------

def _record(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pair, times


def _summed(pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pair, count


def _frames(blocks: Iterator[tuple[np.ndarray, ...]]) -> list[bytes]:
    """Packed frames of about ``FRAME`` records from smaller blocks."""
    out, held, n = [], [], 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= FRAME:
            out += pack(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [], 0
    if held:
        out += pack(*(np.concatenate(c) for c in zip(*held, strict=True)))
    return out


def _marked(blocks: Iterator[tuple[np.ndarray, np.ndarray]], bits_a: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks with a third column: 1 for the highest count of its B id. A B id is held until it is complete."""
    pair, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def mark(pair: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        b = pair >> np.uint64(bits_a)
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        best = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(b))))
        return pair, count, (count == best).astype(np.uint64)

    for p, c in blocks:
        pair, count = np.concatenate([pair, p]), np.concatenate([count, c])
        b = pair >> np.uint64(bits_a)
        done = np.searchsorted(b, b[-1])
        if done:
            yield mark(pair[:done], count[:done])
            pair, count = pair[done:], count[done:]
    if len(pair):
        yield mark(pair, count)


def _merged(weigh, bits_a: int | None):
    def run(t: pa.Table) -> pa.Table:
        blocks = merge([f.as_py() for f in t.column("frames")], weigh)
        if bits_a is not None:
            blocks = _marked(blocks, bits_a)
        radix, name = t.column("radix")[0].as_py(), min(t.column("run").to_pylist())
        return pa.table({
            "radix": pa.array([radix], pa.int32()), "run": pa.array([name], pa.int64()),
            "frames": pa.array([_frames(blocks)], pa.list_(pa.binary())),
        })

    return run


def pair_counts(runs: DataFrame, bits_a: int) -> DataFrame:
    """``radix, run, frames``: one run a partition of ``pair, count, best`` in order."""
    schema = "radix int, run long, frames array<binary>"
    # The partition with most runs says how many are merged at once.
    n = runs.groupBy("radix").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    weigh = _record
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        chunk = F.pmod(F.xxhash64("run"), F.lit(n)).alias("chunk")
        runs = written(runs.select("*", chunk).groupBy("radix", "chunk").applyInArrow(_merged(weigh, None), schema), "merged")
        weigh = _summed
    return written(runs.groupBy("radix").applyInArrow(_merged(weigh, bits_a), schema), "counts")


def _given_back(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document of these runs: links with the highest count, and the sum of counts."""
    held = [unpack(f) for row in runs.column("frames") for f in row.as_py()]
    docs, best, total = [], [], []
    for frame in (f for row in counts.column("frames") for f in row.as_py()):
        pair, count, mark = unpack(frame)
        for p, d, times in held:
            s, e = np.searchsorted(p, pair[0]), np.searchsorted(p, pair[-1], "right")
            if s < e:
                at = np.searchsorted(pair, p[s:e])
                docs.append(d[s:e])
                best.append(times[s:e] * mark[at])
                total.append(times[s:e] * count[at])
        if len(docs) > 4 * FAN_IN:
            docs, best, total = ([x] for x in _per_document(docs, best, total))
    row, best, total = _per_document(docs, best, total)
    return pa.table({"row": row.astype(np.int64), "n_best": best.astype(np.int64), "count_sum": total.astype(np.int64)})


def _per_document(docs: list, best: list, total: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not docs:
        return (np.zeros(0, np.uint64),) * 3
    doc, b, t = (np.concatenate(x) for x in (docs, best, total))
    order = np.argsort(doc, kind="stable")
    first = np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1]))
    return doc[order][first], np.add.reduceat(b[order], first), np.add.reduceat(t[order], first)


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_best, count_sum`` of each document with links."""
    n = runs.groupBy("radix").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chunks = max(1, -(-n // FAN_IN))
    dealt = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(chunks)).alias("chunk"), "frames")
    # A partition's counts go to each of its groups of runs.
    sent = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "frames")
    parts = dealt.groupBy("radix", "chunk").cogroup(sent.groupBy("radix", "chunk")).applyInArrow(
        _given_back, "row long, n_best long, count_sum long"
    )
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs``."""
    stored = encode(docs, a_path, b_path)
    runs = stored.where("radix is not null").select("radix", "run", "frames")
    bits_a = int(ByteLevel(a_path).size).bit_length()
    back = contributions(runs, pair_counts(runs, bits_a))
    rows = stored.where("radix is null").drop("radix", "run", "frames")
    zero = F.lit(0).cast("long")
    return rows.join(back, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
