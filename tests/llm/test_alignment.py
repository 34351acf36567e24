"""Alignment of two tokenizers against dictionaries; runs and their merge against plain counts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lawspark.llm import alignment as AL
from lawspark.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
AWKWARD = [
    (-1, None), (-2, ""), (-3, "  two  spaces "), (-4, "<|endoftext|> <s> </s> <unk> <0x0A>\n\n\t x"), (-5, "é̀ 日本語 🙂 ​ "),
    (None, "a"), (None, "a"), (-6, "▁ x"), (-7, "a\x00b\r\n"), (-8, " "), (-9, "ﬁ ligature"), (-10, "it's we'll they'VE 1234567"),
    (-11, "word " * 20_000), (-12, "x" * 3000), (-1, "a text under a used id"),
]


def brute(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = SentencePieceProcessor(model_file=B)
    name = {i: t for t, i in ta.get_vocab().items()}
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def bytes_a(i):
        return bytes(byte[c] for c in name[i])

    def bytes_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for d, text in rows:
        a = b = []
        if text:
            a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
            raw = (" " + text).encode()
            if b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw:
                a = b = []
        ends = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            at, place = 0, {}
            for k, i in enumerate(ids):
                at += len(of(i))
                place[at] = k
            ends.append(place)
        links, groups, i, j = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][e], ends[1][e]
            links.append((a[x], b[y]))
            groups.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        count.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        docs.append((d, len(a), len(b), len(groups), links, digest))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(
        str((d, na, nb, ng, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), s)) for d, na, nb, ng, ls, s in docs
    )


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row string").repartition(parts)
    return sorted(str(tuple(r)) for r in AL.align(df, A, B).collect())


@pytest.fixture(scope="module")
def rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in given][:120] + AWKWARD


def test_equals_dictionaries(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_many_runs_and_levels(spark, rows, monkeypatch):
    """Runs of a few texts, small frames, two runs merged at once: several levels."""
    for name, value in (("RUN_BYTES", 20_000), ("CALL_BYTES", 5_000), ("FRAME", 50), ("FAN_IN", 2)):
        monkeypatch.setattr(AL, name, value)
    some = rows[60:]
    assert found(spark, some, 2) == brute(some)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == ["(1, 0, 0, 0, 0, 0, 0, '')"]


def test_merge_of_runs(monkeypatch):
    monkeypatch.setattr(AL, "FRAME", 7)
    rng = np.random.default_rng(2)
    for _ in range(20):
        runs, want = [], Counter()
        for _ in range(rng.integers(1, 9)):
            pair = np.sort(rng.integers(0, rng.integers(1, 60), rng.integers(1, 200)).astype(np.uint64))  # repeated within a run
            n = rng.integers(1, 5, len(pair)).astype(np.uint64)
            for p, c in zip(pair.tolist(), n.tolist(), strict=True):
                want[p] += c
            runs.append(AL.pack(pair, n))
        got = list(AL.merge(runs, AL._summed))
        pairs = np.concatenate([p for p, _ in got]).tolist()
        assert pairs == sorted(want)
        assert np.concatenate([c for _, c in got]).tolist() == [want[p] for p in pairs]
        marks = list(AL._marked(iter(got), 3))
        top = defaultdict(int)
        for p, c in want.items():
            top[p >> 3] = max(top[p >> 3], c)
        assert np.concatenate([m for _, _, m in marks]).tolist() == [int(want[p] == top[p >> 3]) for p in sorted(want)]


def test_both_ways_of_side_a_agree():
    t = AL.ByteLevel(A)
    assert t.fast is not None
    texts = [x or "" for _, x in AWKWARD] + ["   　x  ", "ǅ Ⅷ ٣٤ ½ ²", "a b\x85c\x1cd", "don'T İi ſ's", "\U0001d7d8\U0001f468‍\U0001f469"]
    for text in texts:
        assert t.encode(" " + text).tolist() == t.full.encode(" " + text, add_special_tokens=False).ids
