"""Personal data by weak supervision.

Candidates are the *base* spans, fixed by the contract's patterns, and looser
forms of the same kinds (spelt-out addresses, IPv6, local telephone numbers,
other card lengths). Five labelers vote on each: the form, a checksum or range
test, a gazetteer (endings of mail domains, card issuers, reserved networks),
words before the span, and the characters around it.

Expectation-maximisation over the counts of all vote patterns in the corpus
(at most 4 x 3^5 of them) estimates how reliable each labeler is and how
likely each pattern is real. These chances train a logistic span classifier on
a bounded sample of candidates. Base spans always stay; a looser span is added
if the classifier gives it 0.5 or more and it overlaps no base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawspark.session import written

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # candidates that train the span classifier, at most
ROUNDS = 30

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]?\b(?:at|AT)\b[\])]? ?[A-Za-z0-9-]{1,63}"
    r"(?: ?[\[(]?\b(?:dot|DOT)\b[\])]? ?[A-Za-z0-9-]{1,63})+"
)
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])?[0-9]{3}[-. ][0-9]{4}(?![0-9.-]?[0-9])")

# Gazetteers.
_ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu ch at nl be".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")
_RESERVED = re.compile(r"0\.|127\.|255\.|10\.|192\.168\.|(?:22[4-9]|2[3-5][0-9])\.")
_FOR = {
    "email": ("mail", "contact", "write", "reach", "address", "schreib", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "credit", "pay", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "dial", "ruf"),
}
_AGAINST = re.compile(r"version|isbn|order|page|fig|token|key|password|serial|http|[=#$_/]$", re.I)


@dataclass
class Candidate:
    kind: int
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]
    features: list[float]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches, from each @ outwards: linear in the text."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = t.find("@", done)


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns, by kind and start."""
    out = [(0, a, b) for a, b in _emails(t)]
    if not _DIGIT.search(t):
        return out
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _DIGITS.finditer(t):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _looser(t: str) -> Iterator[tuple[int, int, int]]:
    if "dot" in t or "DOT" in t:  # each match holds one of them
        yield from ((0, m.start(), m.end()) for m in _SPELT.finditer(t))
    if not _DIGIT.search(t):
        return
    if ":" in t:
        yield from ((1, m.start(), m.end()) for m in _IP6.finditer(t))
    for m in _DIGITS.finditer(t):
        if 13 <= sum(c.isdigit() for c in m[0]) <= 19:
            yield 2, m.start(), m.end()
    yield from ((3, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(t))


def _judge(t: str, kind: int, start: int, end: int, base: bool) -> Candidate:
    s = t[start:end]
    digits = "".join(_DIGIT.findall(s))
    before, after = t[max(0, start - 1) : start], t[end : end + 1]
    lead = t[max(0, start - 32) : start].lower()
    form = 1 if base else (-1 if s.isdigit() else 0)
    if kind == 0:
        test = 1 if "." in s or "dot" in s.lower() else -1
        ending = re.split(r"[^A-Za-z0-9]+", s)[-1].lower()
        known = 1 if ending in _ENDINGS else -1
    elif kind == 1:
        test, known = 1, (-1 if _RESERVED.match(s) else 1)
    elif kind == 2:
        test, known = (1 if luhn(digits) else -1), (1 if _ISSUERS.match(digits) else -1)
    else:
        test = 1 if 10 <= len(digits) <= 15 else -1
        known = 1 if s[0] in "+(" else (0 if len(digits) == 10 else -1)
    against = bool(_AGAINST.search(lead))
    context = -1 if against else (1 if any(w in lead for w in _FOR[KINDS[kind]]) else 0)
    edge = -1 if (before + after) and re.search(r"[A-Za-z0-9=_/]", before + after) else 1
    votes = (form, test, known, context, edge)
    apart = sum(not c.isalnum() for c in s)
    return Candidate(kind, start, end, base, votes, [
        *(float(kind == k) for k in range(4)), len(digits) / 16, apart / 6, float(s[0] == "+"), float(s.isdigit()),
        float(test > 0), float(known > 0), float(context > 0), float(against), float(edge > 0),
    ])


def candidates(t: str) -> list[Candidate]:
    """All base spans, and looser spans that touch none and not each other."""
    fixed = base_spans(t)
    taken = sorted((a, b) for _, a, b in fixed)
    loose, starts = [], [a for a, _ in taken]
    if taken:
        reach = np.maximum.accumulate([b for _, b in taken])
    last = [0] * 4
    for kind, a, b in _looser(t):
        at = int(np.searchsorted(starts, b, "left")) if taken else 0
        if (not at or reach[at - 1] <= a) and a >= last[kind]:
            loose.append((kind, a, b))
            last[kind] = b
    return [_judge(t, k, a, b, True) for k, a, b in fixed] + [_judge(t, k, a, b, False) for k, a, b in loose]


N_FEATURES = 13


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per candidate, without its text: kind, votes, features."""
    for b in batches:
        kind, votes, features = [], [], []
        for t in b.column("text"):
            for c in candidates(t.as_py() or ""):
                kind.append(c.kind)
                votes.append(sum((v + 1) * 3**i for i, v in enumerate(c.votes)))
                features.append(c.features)
        yield pa.record_batch(
            [pa.array(kind, pa.int32()), pa.array(votes, pa.int32()), pa.array(features, pa.list_(pa.float64()))],
            names=["kind", "votes", "features"],
        )


def expectation_maximisation(kind: np.ndarray, votes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The chance of each (kind, votes) pattern to be real, from pattern counts."""
    v = np.stack([(votes // 3**i) % 3 for i in range(5)], axis=1)
    p = np.clip(0.5 + (v - 1).sum(axis=1) / 10, 0.05, 0.95)
    for _ in range(ROUNDS):
        share = np.zeros((2, 5, 3))
        for i in range(5):
            for x in range(3):
                at = v[:, i] == x
                share[1, i, x] = (count * p)[at].sum() + 1
                share[0, i, x] = (count * (1 - p))[at].sum() + 1
        share /= share.sum(axis=2, keepdims=True)
        prior = np.array([((count * p)[kind == k].sum() + 1) / (count[kind == k].sum() + 2) for k in range(4)])
        log = np.log(share)
        one = np.log(prior)[kind] + sum(log[1, i, v[:, i]] for i in range(5))
        nil = np.log(1 - prior)[kind] + sum(log[0, i, v[:, i]] for i in range(5))
        p = 1 / (1 + np.exp(np.clip(nil - one, -50, 50)))
    return p


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias last) of a logistic regression on chances, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    return w


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the span classifier, learnt from the unlabelled ``docs(text)``.

    Vote patterns are counted over all candidates; the classifier is fitted on
    about ``sample`` of them at most. Without candidates all weights are 0.
    """
    rows = docs.select("text").mapInArrow(_rows, "kind int, votes int, features array<double>")
    # Candidates that look alike are one row.
    patterns = written(rows.groupBy("kind", "votes", "features").agg(F.count("*").alias("n")), "votes")
    seen = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count("*").alias("m")).toPandas()
    if not len(seen):
        return np.zeros(N_FEATURES + 1)
    chance = expectation_maximisation(*(seen[c].to_numpy(np.int64) for c in ("kind", "votes", "n")))
    known = {(int(k), int(v)): p for k, v, p in zip(seen["kind"], seen["votes"], chance, strict=True)}
    share = sample / max(1, int(seen["m"].sum()))
    deal = F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(1 << 30)) / float(1 << 30)
    some = patterns.where(deal < share).toPandas().sort_values(["kind", "votes", "features"], key=lambda c: c.map(str))
    x = np.stack(some["features"].to_list()) if len(some) else np.zeros((0, N_FEATURES))
    y = np.array([known[int(k), int(v)] for k, v in zip(some["kind"], some["votes"], strict=True)])
    return _regression(x, y)


def _spans(t: str, weights: np.ndarray) -> list[dict]:
    out = []
    for c in candidates(t):
        p = float(1 / (1 + np.exp(-np.clip(np.dot(c.features, weights[:-1]) + weights[-1], -30, 30))))
        if c.base or p >= 0.5:
            out.append({"kind": KINDS[c.kind], "start": c.start, "end": c.end, "base": c.base, "p": p})
    return sorted(out, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


_SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,p:double>>"
_SPAN_TYPE = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("p", pa.float64())
]))


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with ``spans`` (code points, end exclusive), by kind and start.

    Null texts have none. A column ``spans`` that ``docs`` has is replaced.
    """
    docs = docs.drop("spans")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"spans {_SPAN}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_spans(t.as_py() or "", weights) for t in b.column("text")]
            yield pa.record_batch([*b.columns, pa.array(spans, _SPAN_TYPE)], names=[*b.schema.names, "spans"])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind, as ``<EMAIL>``; null texts stay null.

    Where spans overlap, the first kind stands for all of them.
    """

    def clean(t: str | None) -> str | None:
        spans = sorted(_spans(t, weights), key=lambda s: s["start"]) if t else []
        if not spans:
            return t
        out, done = [], 0
        for s in spans:
            if s["start"] >= done:
                out += [t[done : s["start"]], f"<{s['kind'].upper()}>"]
            done = max(done, s["end"])
        return "".join([*out, t[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([clean(t.as_py()) for t in b.column(at)], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
