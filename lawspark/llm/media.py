"""Media columns: signature sniffing, validation and carving.

``store`` turns a text into the bytes of a media file: its UTF-8 bytes, padded
with zeros to a multiple of 64, as the samples of an 8-bit mono WAV file.
``inspect`` reads stored bytes back: an Aho-Corasick automaton finds all magic
bytes in one pass, a validator per format checks structure and lengths at each
place, the format that is valid at offset 0 corrects the declared type, and
valid places further in are embedded media that ``carve`` cuts out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

BLOCK = 64
RATE = 8000
WAV = "audio/wav"

# Magic bytes of the formats.
MAGIC = {
    b"RIFF": "riff",
    b"\x89PNG\r\n\x1a\n": "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
    b"BM": "bmp",
    b"%PDF-": "pdf",
    b"OggS": "ogg",
    b"fLaC": "flac",
    b"PK\x03\x04": "zip",
    b"\x1f\x8b\x08": "gzip",
}

Found = tuple[str, int] | None  # type and length


def _riff(b: memoryview, at: int) -> Found:
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    kind = bytes(b[at + 8 : at + 12])
    if at + size > len(b) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    end, p, seen = at + size, at + 12, set()
    while p + 8 <= end:  # chunks must fill the file exactly
        seen.add(bytes(b[p : p + 4]))
        p += 8 + struct.unpack_from("<I", b, p + 4)[0]
        p += (p - at) & 1
    if p != end or (kind == b"WAVE" and not {b"fmt ", b"data"} <= seen):
        return None
    return {b"WAVE": WAV, b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}[kind], size


def _png(b: memoryview, at: int) -> Found:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or (first and kind != b"IHDR"):
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _gif(b: memoryview, at: int) -> Found:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: memoryview, at: int) -> Found:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if kind == 0xDA:
            end = bytes(b[p:]).find(b"\xff\xd9")
            return ("image/jpeg", p + end + 2 - at) if end >= 0 else None
        if not 0xC0 <= kind <= 0xFE:
            return None
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    return None


def _bmp(b: memoryview, at: int) -> Found:
    if at + 54 > len(b):
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    if zero or head not in (40, 108, 124) or not 54 <= offset <= size <= len(b) - at:
        return None
    width, height, planes, bits = struct.unpack_from("<iiHH", b, at + 18)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    return ("image/bmp", size) if offset + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _pdf(b: memoryview, at: int) -> Found:
    end = bytes(b[at:]).find(b"%%EOF")
    return ("application/pdf", end + 5) if end > 0 and bytes(b[at + 5 : at + 6]).isdigit() else None


def _ogg(b: memoryview, at: int) -> Found:
    p = at
    while p + 27 <= len(b) and bytes(b[p : p + 4]) == b"OggS" and b[p + 4] == 0:
        n = b[p + 26]
        body = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if body > len(b):
            break
        p = body
    return ("audio/ogg", p - at) if p > at else None


def _flac(b: memoryview, at: int) -> Found:
    if at + 42 > len(b) or b[at + 4] & 0x7F or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return None
    return "audio/flac", len(b) - at


def _zip(b: memoryview, at: int) -> Found:
    end = bytes(b[at:]).find(b"PK\x05\x06")
    if end < 0 or at + end + 22 > len(b):
        return None
    size, offset, note = struct.unpack_from("<IIH", b, at + end + 12)
    return ("application/zip", end + 22 + note) if size + offset == end else None


def _gzip(b: memoryview, at: int) -> Found:
    d = zlib.decompressobj(31)
    try:
        rest = bytes(b[at:])
        while rest and not d.eof:  # in steps, so that no large output is held
            d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", len(b) - at - len(d.unused_data)) if d.eof else None


VALIDATORS: dict[str, Callable[[memoryview, int], Found]] = {
    "riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf,
    "ogg": _ogg, "flac": _flac, "zip": _zip, "gzip": _gzip,
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (len(magic), kind))
    out.make_automaton()
    return out


def sniff(raw: bytes, machine: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """``(offset, type, length)`` of valid media: the outer one, then those not inside another embedded one."""
    view, out, inside = memoryview(raw), [], 0
    for last, (size, kind) in machine.iter(raw.decode("latin-1")):
        at = last - size + 1
        if at and at < inside:
            continue
        found = VALIDATORS[kind](view, at)
        if found:
            out.append((at, *found))
            if at:
                inside = at + found[1]
    return out


def carve(raw: bytes, found: list[tuple[int, str, int]]) -> list[bytes]:
    """The bytes of the embedded media."""
    return [raw[at : at + n] for at, _, n in found if at]


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8,
                       b"data", len(payload))
    return head + payload


def from_wav(raw: bytes) -> bytes:
    """Samples of a WAV file: the data chunk, wherever it stands."""
    p, end = 12, 8 + struct.unpack_from("<I", raw, 4)[0]
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", raw, p)
        if kind == b"data":
            return raw[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write ``doc_id, n_bytes, media`` of ``docs(doc_id, text)`` and read it back; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [to_wav(x + bytes(-len(x) % BLOCK if x else BLOCK)) for x in raw]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").mapInArrow(
        run, StructType([docs.schema["doc_id"], *StructType.fromDDL("n_bytes long, media binary").fields])
    )
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def inspect(stored: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Digests and features of stored media.

    ``media_type`` is the type found at offset 0 (else the declared one),
    ``corrected`` tells whether it differs from the declared one, ``embedded``
    lists what can be carved. The feature text joins them with the number,
    sum and spread of the samples. Media that are no WAV are their own payload.
    """
    added = StructType.fromDDL(
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "media_type string, corrected boolean, embedded array<struct<offset:long,type:string,length:long>>"
    ).add(StructField("feature", StringType()))
    kept = [stored.schema["doc_id"], stored.schema["n_bytes"]]
    names = [f.name for f in added.fields]
    kinds = pa.schema([
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media_type", pa.string()),
        ("corrected", pa.bool_()),
        ("embedded", pa.list_(pa.struct([("offset", pa.int64()), ("type", pa.string()), ("length", pa.int64())]))),
        ("feature", pa.string()),
    ])

    def facts(raw: bytes, machine) -> dict:
        import numpy as np

        found = sniff(raw, machine)
        kind = found[0][1] if found and found[0][0] == 0 else declared
        payload = from_wav(raw) if kind == WAV else raw
        level = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        inner = [{"offset": a, "type": t, "length": n} for a, t, n in found if a]
        return {
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(raw),
            "media_sha256": hashlib.sha256(raw).hexdigest(), "media_type": kind, "corrected": kind != declared,
            "embedded": inner,
            "feature": f"{kind};n={len(payload)};sum={int(level @ np.arange(256))};levels={int((level > 0).sum())};"
            f"embedded={','.join(f'{x['type']}@{x['offset']}+{x['length']}' for x in inner)}",
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = pa.Table.from_pylist([facts(x or b"", machine) for x in part.column("media").to_pylist()], kinds)
                columns = [rows.column(n).combine_chunks() for n in names]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *names]
                )

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, StructType([*kept, *added.fields]))
