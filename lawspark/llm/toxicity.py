"""Toxic spans by a linear-chain conditional random field.

Labels come per document, so tokens are labelled first: in a toxic training
document a word is a toxic token if the word, or a beginning of it (four to
seven bytes, with or without more to come), is far more frequent in toxic than in other training documents (by its odds and
by a likelihood-ratio test). On windows of these labelled tokens a two-state
chain is trained by gradient steps on its log-likelihood, where the windows
without toxic tokens are thinned out and weigh as many as they stand for.
Features are the hashed word and those beginnings; small weights are dropped.

Most tokens then have no weight at all. Between two tokens with weight the
chain only repeats one fixed step, so forward and backward sums jump over the
gap by a power of that step's matrix, and a text costs as many steps as it has
tokens with weight. The result is exact for the whole text. A document's score
is the chance that at least one of its tokens with weight is toxic, however
small the chance of each; tokens without weight are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawspark.llm import text as T
from lawspark.llm.sampling import labelled_sample, with_texts

BITS = 18
SAMPLE = (6000, 2000)  # other and toxic training documents, at most
PREFIXES = (4, 5, 6, 7)
WIDTH = 1 + len(PREFIXES)  # features of a token
WINDOW = 32
CLEAN_WINDOWS = 1  # windows without toxic tokens kept, for each one with some
MIN_ODDS, MIN_RATIO = 3.0, 25.0  # log-odds, likelihood ratio
STEPS, RATE, L1 = 40, 0.3, 2e-5
_GAPS = 256  # powers of the gap matrix kept; beyond, the last equals the limit
_BUCKET = np.uint64(64 - BITS)


def _features(w: T.Words) -> np.ndarray:
    """Buckets (tokens x WIDTH): the word, and its beginnings, told apart by whether more follows."""
    prefix = T.prefix_sums(w)
    cols = [T.span_hashes(prefix, w.start, w.end)]
    for k in PREFIXES:
        more = (w.end - w.start > k).astype(np.uint64)
        cols.append(T.mix(T.span_hashes(prefix, w.start, np.minimum(w.end, w.start + k)) + np.uint64(2 * k) + more))
    return np.stack([(c >> _BUCKET).astype(np.int64) for c in cols], axis=1)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = T.utf8(b.column("text"))
        out = []
        for i, j in T.slices(offsets):
            w = T.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], T.ALNUM)
            f = _features(w).astype(np.int32)
            cut = np.concatenate([[0], np.cumsum(w.counts())])
            out += [f[cut[d] : cut[d + 1]].ravel() for d in range(j - i)]
        yield pa.record_batch(
            [b.column("doc_id"), b.column("y"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "y", "f"]
        )


def _label(docs: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """0 or 1 for each token of each document."""
    size = 1 << BITS
    seen = np.zeros((2, size))
    for f, label in zip(docs, y, strict=True):
        seen[label, np.unique(f)] += 1
    total = np.maximum(1, np.bincount(y, minlength=2))
    odds = np.log((seen[1] + 0.5) / total[1]) - np.log((seen[0] + 0.5) / total[0])
    expected = np.maximum(1e-9, (seen[0] + seen[1]) * total[1] / total.sum())
    ratio = 2 * seen[1] * np.log(np.maximum(1e-9, seen[1]) / expected)
    toxic = (odds >= MIN_ODDS) & (ratio >= MIN_RATIO)
    return [(toxic[f].any(axis=1) & (label == 1)).astype(np.int64) for f, label in zip(docs, y, strict=True)]


def _windows(docs, tags) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags, mask and weight of windows: those with toxic tokens, and some without."""
    fs, ts = [], []
    for f, t in zip(docs, tags, strict=True):
        for at in range(0, len(t), WINDOW):
            fs.append(f[at : at + WINDOW])
            ts.append(t[at : at + WINDOW])
    has = np.array([t.any() for t in ts], bool)
    clean = np.flatnonzero(~has)
    rng = np.random.default_rng(5)
    some = rng.permutation(clean)[: CLEAN_WINDOWS * max(200, int(has.sum()))]
    stand_for = len(clean) / max(1, len(some))
    clean = some
    pick = np.sort(np.concatenate([np.flatnonzero(has), clean]))
    n = len(pick)
    feats, tag, mask = np.zeros((n, WINDOW, WIDTH), np.int64), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    for r, p in enumerate(pick):
        k = len(ts[p])
        feats[r, :k], tag[r, :k], mask[r, :k] = fs[p], ts[p], True
    return feats, tag, mask, np.where(has[pick], 1.0, stand_for)


def _marginals(e: np.ndarray, mask: np.ndarray, weight: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) per token and expected transitions, of padded windows; e is the score of state 1."""
    n, width = e.shape
    emit = np.stack([np.ones_like(e), np.exp(e)], axis=2)
    step = np.exp(trans)
    a, b = np.zeros((n, width, 2)), np.ones((n, width, 2))
    a[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        nxt = (a[:, t - 1] @ step) * emit[:, t]
        nxt /= nxt.sum(axis=1, keepdims=True)
        a[:, t] = np.where(mask[:, t, None], nxt, a[:, t - 1])
    for t in range(width - 2, -1, -1):
        prv = (emit[:, t + 1] * b[:, t + 1]) @ step.T
        prv /= prv.sum(axis=1, keepdims=True)
        b[:, t] = np.where(mask[:, t + 1, None], prv, b[:, t + 1])
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    pair = a[:, :-1, :, None] * step * (emit[:, 1:] * b[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return p[:, :, 1], (pair * (mask[:, 1:] * weight[:, None])[:, :, None, None]).sum(axis=(0, 1))


def fit_crf(feats, tag, mask, weight) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature weights, transition scores and bias, by proximal AdaGrad steps."""
    size = 1 << BITS
    w, trans, bias = np.zeros(size), np.zeros((2, 2)), -6.0
    g2, t2, b2 = np.full(size, 1e-8), np.full((2, 2), 1e-8), 1e-8
    if not len(tag):
        return w, trans, -8.0
    each = mask * weight[:, None]
    total = each.sum()
    both = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[:, :-1][both], tag[:, 1:][both]), each[:, 1:][both])
    for _ in range(STEPS):
        p, moved = _marginals(w[feats].sum(axis=2) + bias, mask, weight, trans)
        d = (p - tag) * each / total
        g = np.bincount(feats.ravel(), weights=np.repeat(d.ravel(), WIDTH), minlength=size)
        g2 += g * g
        rate = RATE / np.sqrt(g2)
        w -= np.where(g != 0, rate * g, 0.0)
        w = np.sign(w) * np.maximum(0.0, np.abs(w) - np.where(g2 > 1e-8, np.minimum(rate, 1e5) * L1 / STEPS, 0.0))
        gt = (moved - seen) / total
        t2 += gt * gt
        trans -= RATE * gt / np.sqrt(t2)
        b2 += d.sum() ** 2
        bias -= RATE * d.sum() / np.sqrt(b2)
    w[np.abs(w) < 0.5] = 0.0
    return w, trans, bias


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")
    f = table.column("f").combine_chunks()
    flat, at = f.flatten().to_numpy().reshape(-1, WIDTH), np.concatenate([[0], np.cumsum(f.value_lengths().to_numpy())]) // WIDTH
    docs = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    y = table.column("y").to_numpy().astype(np.int64)
    tags = _label(docs, y)
    w, trans, bias = fit_crf(*_windows(docs, tags))
    at = np.flatnonzero(w)
    rest = [bias, *trans.ravel()]
    return pa.table({
        "at": pa.array([*at.tolist(), *range(-1, -6, -1)], pa.int64()),
        "w": pa.array([*w[at].tolist(), *rest], pa.float64()),
    })


class Model:
    """Weights, and the powers of the step over a token without weight."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, bias: float):
        self.w, self.bias, self.step = w, bias, np.exp(trans)
        neutral = np.array([1.0, np.exp(bias)])
        gap = self.step * neutral  # move, then emit a token without weight
        powers, now = [np.eye(2)], np.eye(2)
        for _ in range(_GAPS):
            now = now @ gap
            now = now / now.sum()
            powers.append(now)
        self.powers = np.stack(powers)
        self.neutral = neutral

    def tag(self, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words with weight, and their chance to be toxic."""
        e = self.w[_features(w)].sum(axis=1) if len(w.start) else np.zeros(0)
        at = np.flatnonzero(e)
        if not len(at):
            return at, np.zeros(0)
        doc = w.doc[at]
        first = np.concatenate([[0], np.cumsum(w.counts())])
        lead = at - first[doc]  # tokens before, in the text or since the last one
        same = np.concatenate([[False], doc[1:] == doc[:-1]])
        lead[same] = (at[1:] - at[:-1] - 1)[same[1:]]
        last = np.concatenate([doc[1:] != doc[:-1], [True]])
        tail = np.where(last, first[doc + 1] - at - 1, 0)
        start = np.flatnonzero(~same)
        size = np.diff(np.append(start, len(at)))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        emit = np.stack([np.ones(len(at)), np.exp(e[at] + self.bias)], axis=1)
        ahead, back = np.zeros((len(at), 2)), np.ones((len(at), 2))
        for k in range(int(size[0])):
            i = start[: int(np.searchsorted(-size, -k, "left"))] + k
            if k == 0:  # a text that opens with a token of weight has no step before it
                before = self.powers[np.clip(lead[i] - 1, 0, _GAPS)]
                came = np.einsum("j,njk->nk", self.neutral, before) @ self.step
                came = np.where((lead[i] == 0)[:, None], 1.0, came)
            else:
                came = np.einsum("nj,njk->nk", ahead[i - 1], self.powers[np.minimum(lead[i], _GAPS)]) @ self.step
            now = came * emit[i]
            ahead[i] = now / now.sum(axis=1, keepdims=True)
        for k in range(int(size[0]) - 1, -1, -1):
            n = int(np.searchsorted(-size, -k, "left"))
            i, more = start[:n] + k, size[:n] > k + 1
            end = self.powers[np.minimum(tail[i], _GAPS)].sum(axis=2)
            j = np.where(more, i + 1, i)
            then = (emit[j] * back[j]) @ self.step.T
            then = np.einsum("njk,nk->nj", self.powers[np.minimum(lead[j], _GAPS)], then)
            now = np.where(more[:, None], then, end)
            back[i] = now / now.sum(axis=1, keepdims=True)
        p = ahead * back
        return at, p[:, 1] / p.sum(axis=1)


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: tuple[int, int] = SAMPLE) -> Model:
    """A chain from at most ``sample`` usable labelled documents of each class.

    The sample is bounded, and so are the weights that come back.
    """
    rows = with_texts(docs, labelled_sample(labels, "toxic", usable, sample)).mapInArrow(_sequences, "doc_id long, y int, f array<int>")
    fitted = rows.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(_fit, "at long, w double").toArrow()
    at, value = fitted.column("at").to_numpy(), fitted.column("w").to_numpy()
    w, own = np.zeros(1 << BITS), dict(zip(at.tolist(), value.tolist(), strict=True))
    w[at[at >= 0]] = value[at >= 0]
    trans = np.array([own.get(-2 - i, 0.0) for i in range(4)]).reshape(2, 2)
    return Model(w, trans, own.get(-1, -8.0))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with ``score`` and ``spans``.

    ``spans`` are runs of neighbouring toxic tokens, as code points (end
    exclusive) with the largest chance in the run. Null and empty texts score
    0. Columns ``score`` and ``spans`` that ``docs`` has already are replaced.
    """
    docs = docs.drop("score", "spans")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    added = StructType.fromDDL("score double, spans array<struct<start:long,end:long,p:double>>")
    schema = StructType([*docs.schema.fields, *added.fields])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shipped.value
        for b in batches:
            data, offsets = T.utf8(b.column("text"))
            total, spans = np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for i, j in T.slices(offsets):
                part, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                w = T.words(part, base, T.ALNUM)
                at, p = crf.tag(w)
                doc = w.doc[at]
                none = np.log1p(-np.minimum(p, 1 - 1e-12))
                total[i:j] = np.bincount(doc, weights=none, minlength=j - i)
                hot = at[p >= threshold]
                if len(hot):
                    point = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    chance = dict(zip(at.tolist(), p.tolist(), strict=True))
                    before = -2
                    for t in hot.tolist():
                        d = int(w.doc[t])
                        lead = int(point[base[d]])
                        end = int(point[w.end[t]]) - lead
                        if t == before + 1 and spans[i + d]:
                            last = spans[i + d][-1]
                            last["end"], last["p"] = end, max(last["p"], chance[t])
                        else:
                            spans[i + d].append({"start": int(point[w.start[t]]) - lead, "end": end, "p": chance[t]})
                        before = t
            yield pa.record_batch(
                [*b.columns, pa.array(-np.expm1(total)), pa.array(spans, span_type)],
                names=[*b.schema.names, "score", "spans"],
            )

    return docs.mapInArrow(run, schema)
