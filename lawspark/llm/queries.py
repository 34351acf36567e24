"""Registered queries of the operators, with their contracts' parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawspark.llm import (
    alignment, decontam, licenses, media, minhash, packing, pii, quality, ranked, toxicity, urls, vectors, warc,
)
from lawspark.llm.tables import crc32_of_id, table
from lawspark.session import scratch_dir

# The rules of the contract.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# Ours: hosts with one of these words label their urls "block" for training.
SPAM_WORDS = ("casino", "pills", "adult", "spam")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), tokenizer_path())
    narrow = pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "piece", "deal"
    )
    return packing.place(narrow).drop("piece")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rows = urls.features(pages)
    rows = rows.join(urls.suffix_statistics(rows), "__suffix")
    host = F.col("host")
    # Labelled urls: by the rules, else by words of the host; the others count as allowed.
    label = F.when(host.rlike("|".join(SPAM_WORDS)), 1).otherwise(0)
    rule = urls.rule_of(host, F.col("path"), URL_RULES)
    for name, said in URL_RULES.items():
        label = F.when(rule == name, int(said == "block")).otherwise(label)
    judged = urls.judge(rows, urls.train(rows, label), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), crc32_of_id() % 3 != 1)
    return _judged(quality.score(docs, model), crc32_of_id() % 3 == 1, 0.5)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.store(table(spark, sf_dir, "pages"))
    found = warc.index(spark, archive)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents"), scratch_dir(spark, "media"))
    return media.inspect(stored).drop("embedded")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc32_of_id() % 4 != 2)
    scored = toxicity.score(docs, model)
    return _judged(scored, crc32_of_id() % 4 == 2, 0.3, "spans")


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = ranked.index(table(spark, sf_dir, "documents"))
    return ranked.search(stored, table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def _judged(scored: DataFrame, held_out, threshold: float, *more: str) -> DataFrame:
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), *more,
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_minhash, op3_urls, op4_decontam, op5_licenses, op6_quality, op7_warc, op8_pii, op9_media,
        op10_toxicity, op11_vectors, op12_ranked, op13_alignment,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_terms(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql_base32(hex_text: str) -> str:
    """Base32 of a digest given in hex: five hex digits are four of base32."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    part = f"('0x' || substr({hex_text}, 5 * i + 1, 5))::INTEGER"
    digits = " || ".join(f"substr({letters}, (({part} >> {n}) & 31) + 1, 1)" for n in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range(0, 8), lambda i: {digits}), '')"


def _sql_runs(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"


ORACLES: dict[str, str] = {
    "op2_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce({_sql_runs("text")}, []) AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[f : f + least(len(w), 4) - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS f FROM d WHERE len(w) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (
            SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
            WHERE 100 * m >= 80 * (p.n + q.n - m)
        ),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
        least_id AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM d JOIN least_id ON x = doc_id LEFT JOIN n USING (doc_id)
    """,
    "op4_decontam": f"""
        WITH d AS (SELECT doc_id, coalesce({_sql_words("text")}, []) AS w FROM documents),
        b AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
        i AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[fst : fst + least(len(w), 13) - 1], ' ') AS gram
            FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS fst FROM b WHERE len(w) > 0)
        ),
        g AS (
            SELECT doc_id, l, fst, array_to_string(w[fst : fst + l - 1], ' ') AS gram
            FROM (SELECT d.*, l, unnest(range(1, len(w) - l + 2)) AS fst FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l)
        ),
        h AS (SELECT doc_id, item_id, fst, g.l FROM g JOIN i ON g.l = i.l AND g.gram = i.gram),
        n AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(fst, fst + l)) AS p FROM h) GROUP BY doc_id),
        t AS (
            SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages),
        h AS (SELECT *, sha1(t) AS x FROM p)
        SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_sql_base32("x")} AS payload_digest,
               CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> owner THEN owner END AS refers_to
        FROM h
    """,
    "op11_vectors": """
        WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b
            ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
        ),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM u UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
        FROM u JOIN least ON vec_id = least.x LEFT JOIN n ON vec_id = n.x
    """,
    "op12_ranked": f"""
        WITH d AS (SELECT doc_id, {_sql_terms("text")} AS t FROM documents),
        c AS (SELECT count(*)::BIGINT AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
        p AS (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
        tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
        df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
        q AS (SELECT item_id, unnest({_sql_terms("text")}) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
        s AS (
            SELECT item_id, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY ALL
        )
        SELECT item_id, rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0
        ) WHERE rank <= 10
    """,
}
