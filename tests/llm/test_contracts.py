"""Registered queries on the smallest given tables, and operators on awkward rows, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lawspark.llm import decontam, licenses, media, minhash, packing, pii, quality, toxicity, urls, warc
from lawspark.llm import queries as Q
from llm import brute

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "apache license a@b.co 1.2.3.4"
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (2, "Alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (2, "Alpha BETA gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (3, None), (4, ""), (5, "   \n\t"), (6, "one"), (7, "ONE"), (8, "two words"),
    (None, "no id here, CC by: the MIT  license"), (9, LONG), (10, LONG + " end"), (11, "é É ß \u00a0 \u2003x 字"),
    (12, "GNU\nGeneral--Public License; cc-by mit license mit license"), (13, "<|endoftext|> it's 12,5 don't"),
    (14, "x@y.z.w@q.r +1 (555) 010-9999 4111 1111 1111 1111 999.1.1.1 1.2.3.4.5.6.7.8"), (1, "another text under id one"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(d, t, "en", 1.0, d) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, spans double, row long").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def check_pieces(rows, docs, length=4096):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(Q.tokenizer_path())
    ids = [np.array(encoder.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in docs]
    want = Counter()
    for (d, _), x in zip(docs, ids, strict=True):
        for s in range(0, len(x), length):
            part = x[s : s + length]
            want[d, s, len(part), zlib.crc32(part.tobytes()), len(x)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return sum(len(x) for x in ids) / (length * len(bins))


def pack(df):
    pieces = packing.tokenise(df, Q.tokenizer_path())
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "piece", "deal")
    return pieces, packing.place(narrow)


def test_packing(spark, docs, awkward, empty):
    assert check_pieces(Q.op1_packing(spark, SF).collect(), docs) > 0.97
    pieces, placed = pack(awkward)
    check_pieces(placed.collect(), TEXTS)
    whole = packing.sequences(pieces, placed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.n_tokens for r in whole)
    assert pack(empty)[1].count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 100) for _ in range(500)])
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= sizes[i]
    assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


def test_tokenizer_words_are_borders():
    from tokenizers import Tokenizer

    from lawspark.llm import text as T

    encoder, words = Tokenizer.from_file(Q.tokenizer_path()), packing.WordTokenizer(Q.tokenizer_path())
    rng = random.Random(4)
    signs = "abcXYZ 019 \t\n.,!?'<|>-_#$ éÉßñ字\u00a0\u0301\u2028\x00\x1c\x85İǅ" + "'s't're<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    import pyarrow as pa

    data, offsets = T.utf8(pa.array(texts))
    ids, to = words.encode(data, offsets, 2)
    for i, t in enumerate(texts):
        assert ids[to[i] : to[i + 1]].tolist() == encoder.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_minhash(spark, docs, awkward, empty):
    want = brute.near_duplicates(docs, 4)
    got = {r.doc_id: r for r in Q.op2_minhash(spark, SF).collect()}
    assert all((got[d].n_shingles, got[d].component_id) == w for (d, _), w in zip(docs, want, strict=True))
    rows = minhash.near_duplicates(awkward, k=4, carry=("row",)).collect()
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows],
         [(d, n, c, d == c) for (d, _), (n, c) in zip(TEXTS, brute.near_duplicates(TEXTS, 4), strict=True)])
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_crowds(spark, monkeypatch):
    """Many texts share a passage, in families of near copies: the crowd rounds must find every family."""
    monkeypatch.setattr(minhash, "CENTRES", 1)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(25):
        own = passage + [f"f{family}w{i}" for i in range(12)]
        for _ in range(4):
            w = list(own)
            w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, k=4).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, brute.near_duplicates(rows, 4), strict=True)}


def test_minhash_joins_the_unresolved_once(spark, monkeypatch):
    """Members of mixed buckets are read twice but found once, at the first level and in the crowds."""
    monkeypatch.setattr(minhash, "CENTRES", 1)
    seen, want, plain = spark.sparkContext.accumulator(0), [], minhash._unresolved

    def counted(members, label):
        out = plain(members, label)
        want.append(out.count())

        def each(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return out.mapInArrow(each, out.schema)

    monkeypatch.setattr(minhash, "_unresolved", counted)
    passage = [f"p{i}" for i in range(60)]
    rows = [(n, " ".join(passage + [f"f{n // 2}w{i}" for i in range(12)] + [f"x{n}"])) for n in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for (d, _), (_, c) in zip(rows, brute.near_duplicates(rows, 4), strict=True)}
    assert len(want) > 1 and sum(want) > 0 and seen.value == sum(want)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64) * np.uint64(2)
    for size in (3, 40, 1000):
        a, b = np.sort(pool[:size]), np.sort(pool[size // 10 : size + size // 10])
        sig = minhash.signatures([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.2


def test_urls(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    got = Q.op3_urls(spark, SF).collect()
    want = [(p, *brute.url_parts(u), brute.url_rule(*brute.url_parts(u))) for p, u in pages]
    same([(r.page_id, r.host, r.path, r.rule) for r in got], want)
    assert all(r.verdict == brute.RULES[r.rule] for r in got if r.rule)
    odd = [None, "", "no scheme", "http://", "http://A.NET", "http://a.Net/", "ftp://x.org/fr/a?b#c", "a://b://c/d",
           "http://example.net/en/", "http://notexample.net/en/x", "http://x\n.org/fr/\ny?q", "http://net/?://z", "http://a.com?b/c"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(odd)], "page_id long, url string, score string")
    rows = urls.features(df)
    rows = rows.join(urls.suffix_statistics(rows), "__suffix")
    judged = urls.judge(rows, urls.train(rows, F.lit(None)), Q.URL_RULES)
    same([(r.page_id, r.host, r.path, r.rule) for r in judged.collect()],
         [(i, *brute.url_parts(u), brute.url_rule(*brute.url_parts(u))) for i, u in enumerate(odd)])
    assert urls.judge(rows.where("false"), None, Q.URL_RULES).count() == 0


def contamination(df, benchmark):
    found = decontam.contaminated_words(df, benchmark)
    return [
        (r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.bad)
        for r in found.withColumn("bad", decontam.is_contaminated()).collect()
    ]


def test_decontamination(spark, docs, awkward, empty, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    same([tuple(r) for r in Q.op4_decontam(spark, SF).collect()], brute.decontaminate(docs, items))
    odd = [(1, TEXTS[0][1]), (2, "one"), (3, None), (4, ""), (5, "mit license"), (6, "mit license"), (7, "word " * 14),
           (8, "unseen words only"), (9, "É ß"), (10, "words two")]
    bench = spark.createDataFrame(odd, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)  # several blocks
    same(contamination(awkward, bench), brute.decontaminate(TEXTS, odd))
    assert contamination(empty, bench) == []
    assert all(r[2] == 0 for r in contamination(awkward, bench.where("false")))
    bad = {t for (_, t), r in zip(TEXTS, brute.decontaminate(TEXTS, odd), strict=True) if r[-1]}
    kept = decontam.clean(awkward, bench)
    assert kept.columns == awkward.columns
    same([r.text for r in kept.collect()], [t for _, t in TEXTS if t not in bad])


def test_licenses(spark, docs, awkward, empty):
    got = Q.op5_licenses(spark, SF).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got],
         [(d, *brute.license_base(t)) for d, t in docs])
    rows = licenses.scan(awkward).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows],
         [(d, *brute.license_base(t)) for d, t in TEXTS])
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
    assert licenses.scan(empty).count() == 0


def test_license_suppression(spark):
    text = "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT\nCreative Commons Attribution 4.0"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = {(r.label, text[r.start : r.end]) for r in row.found}
    assert ("apache-2.0", "Apache License, Version 2.0") in found
    assert ("mit", "SPDX-License-Identifier: MIT") in found
    assert ("cc-by-4.0", "Creative Commons Attribution 4.0") in found
    assert ("apache", "Apache License") not in found  # inside the versioned name
    assert len(licenses.rules()) > 200


def test_archive(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    same([tuple(r) for r in Q.op7_warc(spark, SF).collect()], brute.warc(pages))
    odd = [(1, "http://a\r\nb", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 100_000), (6, "", "")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = warc.store(df)
    found = warc.index(spark, path)
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()],
         brute.warc([(p, h) for p, _, h in odd]))
    assert found.where("payload_digest <> stated_digest").count() == 0
    for r in warc.records(spark, path).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = warc.parse_header(head + b"\r\n\r\n")
        html = (next(h for p, _, h in odd if p == r.page_id) or "").encode()
        want = html if fields["WARC-Type"] == "response" else b""
        assert body == want + b"\r\n\r\n" and int(fields["Content-Length"]) == len(want)
    assert warc.index(spark, warc.store(df.where("false"))).count() == 0
    twice = warc.store(df.unionAll(df.where("page_id = 2")))  # a repeated owner: its payload is still stored once
    assert spark.read.parquet(f"{twice}/payloads").groupBy("digest").count().where("count > 1").count() == 0
    assert sorted(r.page_id for r in warc.index(spark, twice).collect()) == [1, 2, 2, 3, 4, 5, 6]


def pii_row(t):
    spans = brute.pii_base(t)
    n = Counter(k for k, _, _ in spans)
    text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return (*(n[k] for k in pii.KINDS), hashlib.sha256(text.encode()).hexdigest())


def test_personal_data(spark, docs, awkward, empty):
    got = Q.op8_pii(spark, SF).collect()
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], [(d, *pii_row(t)) for d, t in docs])
    weights = pii.train(awkward)
    for r in pii.find(awkward, weights).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == brute.pii_base(r.text)
    clean = pii.redact(awkward, weights)
    assert clean.columns == awkward.columns
    left = [r.text for r in clean.collect()]
    assert len(left) == len(TEXTS) and not any(brute.pii_base(t) for t in left)
    assert sum(t is None for t in left) == 1
    assert (pii.train(empty) == 0).all() and pii.find(empty, weights).count() == 0


def test_base_spans_as_the_patterns():
    rng = random.Random(3)
    for signs in ("ab1.@-_+% ", "0123 .-+()", "19.25 ", "4539 1488-03436467", "a@b.c@"):
        for _ in range(3000):
            t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
            got = [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)]
            assert got == brute.pii_base(t), repr(t)
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 70_000, "a b dot " * 20_000):
        pii.candidates(t)  # no quadratic time


def test_media(spark, docs, awkward, empty):
    got = Q.op9_media(spark, SF).collect()
    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    same([(r.doc_id, *(r[c] for c in columns)) for r in got], [(d, *brute.media(t)) for d, t in docs])
    from lawspark.session import scratch_dir

    rows = media.inspect(media.store(awkward, scratch_dir(spark, "media"))).collect()
    same([(r.doc_id, *(r[c] for c in columns)) for r in rows], [(d, *brute.media(t)) for d, t in TEXTS])
    assert all(r.media_type == "audio/wav" and r.corrected for r in rows)
    assert media.inspect(media.store(empty, scratch_dir(spark, "media"))).count() == 0


def test_sniffing_and_carving():
    import gzip
    import io
    import zipfile

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"\x2c" + bytes(9) + b"\x02\x01\x00\x00" + b"\x3b"
    packed = gzip.compress(b"hello " * 50, mtime=0)
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("a.txt", "hello")
    machine = media.automaton()
    parts = [png, gif, packed, file.getvalue(), media.to_wav(bytes(64))]
    raw = b"start" + b"--".join(parts) + b"end"
    found = media.sniff(raw, machine)
    assert media.carve(raw, found) == parts
    assert [t for _, t, _ in found] == ["image/png", "image/gif", "application/gzip", "application/zip", "audio/wav"]
    broken = [png[:-3], png.replace(b"x", b"y"), gif[:-1], packed[:-9], b"GIF89a", b"RIFF\xff\xff\xff\xffWAVE", b"BM", b"%PDF-1.4 no end"]
    for b in broken:
        assert media.sniff(b"start" + b, machine) == []


def learnable(spark):
    """Texts whose label shows in their words; ids null or repeated among them."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) for _ in range(40)]
        if bad:
            for k in rng.sample(range(40), 4):
                w[k] = rng.choice(["vilest", "vilely", "nasty"])
        rows.append((i, " ".join(w) + (" %%% $$$ ###" * 10 if bad else ".")))
        labels.append((i, int(not bad), int(bad)))
    labels += [(None, 1, 1), (0, None, None), (1, 7, 7), (1, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, awkward, empty):
    docs, labels = learnable(spark)
    w = quality.train(docs, labels, Q.crc32_of_id() % 3 != 1)
    held = quality.score(docs, w).where(Q.crc32_of_id() % 3 == 1).collect()
    assert len(held) > 100 and all((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held)
    scored = quality.score(awkward, w)
    assert scored.columns == [*[c for c in awkward.columns if c != "score"], "score"]
    rows = scored.collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    nothing = quality.train(empty, labels.where("false"), F.lit(True))
    assert not nothing.any() and quality.score(empty, nothing).count() == 0
    got = Q.op6_quality(spark, SF).collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity(spark, awkward, empty):
    docs, labels = learnable(spark)
    model = toxicity.train(docs, labels, Q.crc32_of_id() % 4 != 2)
    held = toxicity.score(docs, model).where(Q.crc32_of_id() % 4 == 2).collect()
    assert len(held) > 80 and all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held)
    for r in held:
        for s in r.spans:
            assert all(x.startswith(("vil", "nasty")) for x in r.text[s.start : s.end].split())
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if not (r.text or "").strip())
    nothing = toxicity.train(empty, labels.where("false"), F.lit(True))
    assert toxicity.score(empty, nothing).count() == 0
    got = Q.op10_toxicity(spark, SF).collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_chain_against_plain_forward_backward():
    """Jumping over gaps gives the marginals of the whole chain."""
    import pyarrow as pa

    from lawspark.llm import text as T

    rng = np.random.default_rng(2)
    w = np.zeros(1 << toxicity.BITS)
    texts = ["a b hot c d", "hot", "", "x " * 700 + "hot y hot hot " + "z " * 400, "none here", "hot end"]
    data, offsets = T.utf8(pa.array(texts))
    words = T.words(data, offsets, T.ALNUM)
    f = toxicity._features(words)
    hot = [data[s:e].tobytes() == b"hot" for s, e in zip(words.start, words.end, strict=True)]
    w[f[np.flatnonzero(hot)[0], 0]] = 2.5
    trans, bias = rng.normal(size=(2, 2)), -1.5
    at, p = toxicity.Model(w, trans, bias).tag(words)
    assert at.tolist() == np.flatnonzero(hot).tolist()
    want = []
    for d in range(len(texts)):
        own = np.flatnonzero(words.doc == d)
        if len(own):
            e = (w[f[own]].sum(axis=1) + bias)[None]
            want += toxicity._marginals(e, np.ones_like(e, bool), np.ones(1), trans)[0][0][np.array(hot)[own]].tolist()
    assert np.allclose(p, want, atol=1e-9)
