"""Registered queries: one per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawspark.functions.text import lines, word_count
from lawspark.operators import (
    citation, citation_index, context, dense, lexical, parse, parse_blocks, postings, profile, retrieve, search, toolcalls, vector_index,
)
from lawspark.operators.chunk import chunk_documents
from lawspark.operators.points import build_points
from lawspark.plans.corpora import (
    code_chunks, direct_requests, responses, statute_texts, statutes_of, supplier_requests, table,
)
from lawspark.session import scratch_dir, spread, written
from lawspark.sources import changes, collection, corpus, model_store
from lawspark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


# --- text and lexical -------------------------------------------------------

def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    t = lexical.tokenise(docs, "doc_id")
    return t.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("bigint").alias("n_terms"),
    )


def bm25_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = lexical.fit(documents(spark, sf)).stats
    return s.select("doc_count", "total_len", r6("avgdl").alias("avgdl"))


def bm25_vocab(spark: SparkSession, sf: str) -> DataFrame:
    model = lexical.with_term_ids(lexical.fit(documents(spark, sf)))
    return model.vocab.select("term", "term_id", "df", r6("idf").alias("idf"))


def bm25_sparse_vectors(spark: SparkSession, sf: str) -> DataFrame:
    counts = written(lexical.term_counts(documents(spark, sf), "doc_id"), "counts")
    v = lexical.sparse_vectors(counts, lexical.fit(counts), "doc_id", key="term", keep_empty=False)
    post = v.select("doc_id", F.explode(F.arrays_zip("indices", "values")).alias("p"))
    return post.select("doc_id", F.col("p.indices").alias("term"), r6("p.values").alias("weight"))


def bm25_pair_score(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against one of the benchmark texts."""
    docs, bench = documents(spark, sf), table(spark, sf, "benchmark")
    n = bench.select(F.count("*")).scalar()
    pairs = docs.select("doc_id", "text", (F.col("doc_id") % n).alias("item_id")).join(
        bench.select("item_id", F.col("text").alias("query")), "item_id"
    )
    scores = lexical.pair_scores(pairs, _model_for(docs, bench), ["item_id", "doc_id"])
    return scores.select("item_id", "doc_id", r6("score").alias("score"))


def _model_for(docs: DataFrame, queries: DataFrame) -> lexical.BM25Model:
    """Model of a corpus, kept to the terms the queries hold."""
    return lexical.fit(docs, only_terms=lexical.query_terms(queries))


def _corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return documents(spark, sf), table(spark, sf, "benchmark").select("item_id", "text")


def _ranked(df: DataFrame, query: str, item: str) -> DataFrame:
    return df.select(
        F.col("query_id").alias(query), F.col("id").alias(item), r6("score").alias("score"), "rank"
    )


def sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs, bench = _corpus(spark, sf)
    sides = lexical.search_vectors(docs, bench, _model_for(docs, bench), "doc_id", "item_id")
    return _ranked(search.sparse_search(*sides, k=14), "item_id", "doc_id")


def collection_sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over stored postings: index once, then read the asked terms only."""
    docs, bench = _corpus(spark, sf)
    model = lexical.fit(docs)
    name = "postings_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
    stored = search.postings(docs, model, "doc_id", name)
    return _ranked(search.postings_search(stored, bench, model, "item_id", k=14), "item_id", "doc_id")


def block_max_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same search over stored blocks of like impact, of which those that cannot matter are skipped."""
    docs, bench = _corpus(spark, sf)
    model = lexical.fit(docs)
    own = lexical.sparse_vectors(docs, model, "doc_id", key="term", keep_empty=False)
    stored = postings.build(own, scratch_dir(spark, "postings"))
    asked = lexical.sparse_vectors(bench, model, "item_id", key="term")
    return _ranked(postings.search(stored, asked, k=14), "item_id", "doc_id")


def _open_hyphen_segmenter():
    """Stand-in for a word segmenter: joins "of the" into one word."""
    return lambda texts: [t.replace("of the", "of_the") for t in texts]


def segmented_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = lexical.tokenise(documents(spark, sf), "doc_id", segmenter=_open_hyphen_segmenter)
    return t.select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.filter("tokens", lambda x: x == "of_the")).cast("bigint").alias("n_joined"),
    )


def model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary of a model saved twice and loaded."""
    path = scratch_dir(spark, "model")
    model = lexical.fit(documents(spark, sf))
    model_store.save_model(model, path)
    model_store.save_model(model_store.load_model(spark, path), path)
    return model_store.load_model(spark, path).vocab.select("term", "df", r6("idf").alias("idf"))


# --- dense ------------------------------------------------------------------

def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those that stand for the benchmark queries."""
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    bench = table(spark, sf, "benchmark").select("item_id")
    return emb, emb.join(bench, emb.vec_id == bench.item_id, "left_semi")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(dense.nearest(*_vectors(spark, sf), k=14), "item_id", "vec_id")


def dense_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = dense.nearest(*_vectors(spark, sf), k=14, threshold=dense.DENSE_THRESHOLD)
    return _ranked(found, "item_id", "vec_id")


def _dense_metric(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _ranked(dense.nearest(*_vectors(spark, sf), k=7, distance=metric), "item_id", "vec_id")

    return run


def _indexed(metric: str, k: int) -> Query:
    """The same neighbours over stored vectors, cells and rings out of reach unread."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items, queries = _vectors(spark, sf)
        index = vector_index.build(items, scratch_dir(spark, "vectors"), metric, cells=32)
        return _ranked(vector_index.search(index, queries, k), "item_id", "vec_id")

    return run


def vector_normalize(spark: SparkSession, sf: str) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    scaled = emb.select("vec_id", F.posexplode(dense.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))))
    return scaled.select("vec_id", F.col("pos").cast("bigint").alias("pos"), r6("col").alias("x"))


LETTERS = "aeiou"


def _open_letter_model():
    """Stand-in for an embedding model: how often each vowel occurs."""
    return lambda texts: [[t.count(c) for c in LETTERS] for t in texts]


def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    v = docs.select("doc_id", dense.embed(F.col("text"), _open_letter_model).alias("v"))
    return v.select(
        "doc_id",
        *[r6(F.get("v", F.lit(i)).cast("double")).alias(f"v_{c}") for i, c in enumerate(LETTERS)],
    )


# --- retrieval --------------------------------------------------------------

def _hybrid(
    spark: SparkSession, sf: str, model: lexical.BM25Model, limit: int = dense.TOP_K
) -> DataFrame:
    emb, vectors = _vectors(spark, sf)
    docs, bench = _corpus(spark, sf)
    items, queries = lexical.search_vectors(docs, bench, model, "doc_id", "item_id")
    return search.hybrid_search(emb, vectors, items, queries, limit)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, _model_for(*_corpus(spark, sf))).select(
        F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "total_score",
        r6("dense_score").alias("dense_score"), r6("sparse_score").alias("sparse_score"), "rank",
    )


def hybrid_dense_fallback(spark: SparkSession, sf: str) -> DataFrame:
    emb, queries = _vectors(spark, sf)
    return search.hybrid_search(emb, queries, None).select(
        F.col("query_id").alias("item_id"), F.col("id").alias("vec_id"), "total_score",
        "dense_score", "sparse_score", "rank",
    )


def rerank_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Fused candidates reranked by their BM25 score against the query."""
    docs, bench = _corpus(spark, sf)
    model = _model_for(docs, bench)
    # Few rows: the depth times the queries. Written, so that Spark knows their
    # size and reads the documents in place.
    candidates = written(
        _hybrid(spark, sf, model, search.candidate_limit(rerank=True)), "candidates"
    )
    pairs = search.with_payload(candidates, docs, "doc_id").join(
        bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id"
    )
    scores = lexical.pair_scores(pairs, model, ["query_id", "id", "rank"])
    scored = scores.withColumn("score", r6("score")).withColumn("total_score", F.lit(0.0))
    best = search.rerank(scored, search.RERANK_TOP_N, "score")
    return best.select(
        F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "total_score", "rank"
    )


# --- profile ----------------------------------------------------------------

def chunk_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return profile.lengths(_statute_chunks(spark, sf)).select(
        "doc_id", *_pos_columns(), "n_chars", "n_words"
    )


def length_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = profile.length_summary(documents(spark, sf))
    return s.withColumn("avg_chars", r6("avg_chars"))


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = profile.length_histogram(documents(spark, sf))
    return h.select("measure", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


def length_density(spark: SparkSession, sf: str) -> DataFrame:
    d = profile.length_density(documents(spark, sf), grid_size=50)
    return d.select("measure", "grid", r6("x").alias("x"), F.round("density", 9).alias("density"))


# --- statutes ---------------------------------------------------------------

def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return parse.parse_documents(statute_texts(spark, sf))


def _statute_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(_tree(spark, sf))


def _pos_columns() -> list[Column]:
    return [F.col(f"chunk_pos.{n}").alias(f"{n}_pos") for n in ("chapter", "article", "clause", "point")]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def parse_documents(spark: SparkSession, sf: str) -> DataFrame:
    articles = F.aggregate(
        "chapters", F.lit(0).cast("bigint"), lambda n, c: n + F.size(c["articles"])
    )
    return _tree(spark, sf).select(
        "doc_id", "document_title", "legal_basis",
        F.size("chapters").cast("bigint").alias("n_chapters"), articles.alias("n_articles"),
    )


def parse_articles(spark: SparkSession, sf: str) -> DataFrame:
    return parse.explode_articles(_tree(spark, sf)).select(
        "doc_id", *_long("chapter_pos", "article_pos"), "chapter_number", "chapter_title",
        "article_number", "article_title", "category",
    )


def parse_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return parse.explode_clauses(_tree(spark, sf)).select(
        "doc_id", "article_number", *_long("clause_pos"), "clause_number", "content"
    )


def parse_points(spark: SparkSession, sf: str) -> DataFrame:
    return parse.explode_points(_tree(spark, sf)).select(
        "doc_id", "article_number", "clause_number", *_long("point_pos"), "point", "content"
    )


def parse_blocks_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the statutes cut into blocks of 50 lines, each parsed apart."""
    parts = parse_blocks.parse_blocks(parse_blocks.cut(statute_texts(spark, sf)))
    return parts.points.select("doc_id", "article_number", "clause_number", *_long("point_pos"), "point", "content")


def parse_blocks_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses of the harder statutes, in blocks of 20 lines."""
    texts = statutes_of(documents_with_origin(spark, sf), hard=True)
    parts = parse_blocks.parse_blocks(parse_blocks.cut(texts, 20))
    return parts.clauses.select("doc_id", "article_number", *_long("clause_pos"), "clause_number", "content")


def preamble_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Split of the texts as they are: no mark, so both parts are the whole text; ``preamble_split`` has the mark."""
    cut = parse.split_preamble(documents(spark, sf))
    return cut.select(
        "doc_id",
        F.size(lines(F.col("preamble"))).cast("bigint").alias("preamble_lines"),
        F.size(lines(F.col("body"))).cast("bigint").alias("body_lines"),
        word_count(F.col("body")).cast("bigint").alias("body_words"),
    )


def preamble_split(spark: SparkSession, sf: str) -> DataFrame:
    """Split of the statutes, which hold the mark unless they have no units."""
    cut = parse.split_preamble(statute_texts(spark, sf))
    return cut.select(
        "doc_id", "preamble", F.size(lines(F.col("body"))).cast("bigint").alias("body_lines"),
        F.get(lines(F.col("body")), F.lit(0)).alias("body_head"),
    )


def chunk_hard(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of statutes with headings inside points and clauses without a number."""
    c = chunk_documents(parse.parse_documents(statutes_of(documents_with_origin(spark, sf), hard=True)))
    return c.where(F.col("chunk_kind") != "legal_basis").select("doc_id", *_pos_columns(), "text", *_LINEAGE)


def chunk_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of stored statutes some of whose keys are missing: titles of even documents and of odd chapters."""
    def untitled(c: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, c.withField("chapter_title", F.lit(None).cast("string"))).otherwise(c)

    tree = _tree(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 1, F.col("document_title")).alias("document_title"), "legal_basis",
        F.transform("chapters", untitled).alias("chapters"),
    )
    path = scratch_dir(spark, "json")
    corpus.write_documents(tree, path)
    good, _ = corpus.read_document_lines(spark, path)
    c = chunk_documents(good).where(F.col("chunk_kind") != "legal_basis")
    return c.select(*_long("doc_id"), *_pos_columns(), "document_title", "chapter_title", "article_title", "text")


def _of_kind(kind: str, *columns: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = _statute_chunks(spark, sf).where(F.col("chunk_kind") == kind)
        return c.select("doc_id", *_pos_columns(), "text", *columns)

    return run


_LINEAGE = (
    "document_title", "chapter_number", "chapter_title", "article_number", "article_title",
    "article_category", "clause_number", "point", "is_point",
)


def chunk_code(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the relational form, with their references."""
    c = code_chunks(spark, sf)
    return c.select(
        "doc_id", *_pos_columns(), "text", "point", "is_point",
        F.concat_ws(";", F.transform(
            "references",
            lambda r: F.concat_ws("|", r["document"], r["article"].cast("string"), r["point"]),
        )).alias("refs"),
    )


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The id of each passage of the statutes."""
    return _statute_chunks(spark, sf).select("doc_id", *_pos_columns(), "chunk_id")


def texts_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One text file per benchmark item, written and read back."""
    path = scratch_dir(spark, "texts")
    bench = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value"))
    bench.repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    read = corpus.read_texts(spark, f"{path}/*/*.txt")
    return read.select(
        F.regexp_extract("doc_id", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"),
        F.regexp_replace("text", r"\n\z", "").alias("text"),
    )


def documents_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed statutes of labelled toxic documents as JSON files, every seventh broken: read and quarantined.

    One file per document, so a part of the documents only, which the oracle
    fixes; ``documents_json_lines_round_trip`` takes all. ``same`` tells whether the tree that was read equals the one written.
    """
    texts = statute_texts(spark, sf).join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    tree = written(parse.parse_documents(texts), "tree")
    path = scratch_dir(spark, "json")
    end = F.when(F.col("doc_id") % 7 == 0, "}").otherwise("")
    body = F.concat(F.to_json(F.struct("document_title", "legal_basis", "chapters")), end)
    files = tree.select("doc_id", body.alias("value"))
    files.repartition("doc_id").write.partitionBy("doc_id").text(path)
    good, bad = corpus.read_documents(spark, f"{path}/*/*.txt")
    number = F.regexp_extract("doc_id", "doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id")
    read = good.select(number, F.to_json(F.struct("document_title", "legal_basis", "chapters")).alias("read"))
    rows = read.unionByName(bad.select(number, F.lit(None).cast("string").alias("read")))
    return rows.join(files, "doc_id").select(
        "doc_id", F.col("read").isNotNull().alias("good"), F.coalesce(F.col("read") == F.col("value"), F.lit(False)).alias("same")
    )


def documents_json_lines_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All parsed statutes as JSON lines, every seventh broken: read and quarantined.

    ``same`` tells whether the tree that was read equals the one written.
    """
    tree = written(_tree(spark, sf).select("doc_id", "document_title", "legal_basis", "chapters"), "tree")
    path = scratch_dir(spark, "json")
    broken = F.col("doc_id") % 7 == 0
    corpus.write_documents(tree.where(~broken), path)
    line = F.concat(F.to_json(F.struct(*tree.columns)), F.lit("}"))
    tree.where(broken).select(line.alias("value")).write.mode("append").text(path)
    good, bad = corpus.read_document_lines(spark, path)

    def digest(chapters: Column) -> Column:
        return F.sha2(F.to_json(F.struct("document_title", "legal_basis", chapters.alias("chapters"))), 256)

    read = good.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("chapters")).alias("read"))
    lost = F.regexp_extract("text", r'^\{"doc_id":([0-9]+),', 1).cast("bigint").alias("doc_id")
    rows = read.unionByName(bad.select(lost, F.lit(None).cast("string").alias("read")))
    return rows.join(tree.select("doc_id", digest(corpus.lean(F.col("chapters"))).alias("put")), "doc_id").select(
        "doc_id", F.col("read").isNotNull().alias("good"), F.coalesce(F.col("read") == F.col("put"), F.lit(False)).alias("same")
    )


def _statute_collection(spark: SparkSession, doc_id: str) -> str:
    """A new collection whose documents have ids of the type ``doc_id``."""
    name = "statutes_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
    collection.ensure_collection(
        spark, name, dim=len(LETTERS), location=scratch_dir(spark, "statutes"),
        columns=collection.POINT_COLUMNS.replace("doc_id string", f"doc_id {doc_id}"),
    )
    return name


def _letters() -> Column:
    return dense.embed(F.col("text"), _open_letter_model)


def collection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """First hundred points of all first articles in a stored collection."""
    name = _statute_collection(spark, "bigint")
    collection.upsert(build_points(_statute_chunks(spark, sf), _letters(), None), name)
    collection.compact(spark, name)
    found = citation.scan(collection.current(spark, name), F.col("article_number") == 1, 100)
    return found.select("doc_id", *_pos_columns(), "text")


def collection_recreated(spark: SparkSession, sf: str) -> DataFrame:
    """A collection dropped and created anew holds only what came after."""
    name = _statute_collection(spark, "bigint")
    points = build_points(_statute_chunks(spark, sf), _letters(), None)
    collection.upsert(points.where(F.col("doc_id") % 2 == 0), name)
    collection.drop_collection(spark, name)
    columns = collection.POINT_COLUMNS.replace("doc_id string", "doc_id bigint")
    for _ in range(2):  # the second is a no-op
        collection.ensure_collection(
            spark, name, dim=len(LETTERS), location=scratch_dir(spark, "statutes"), columns=columns
        )
    collection.upsert(points.where(F.col("doc_id") % 2 == 1), name)
    return collection.current(spark, name).select("doc_id", *_pos_columns(), "text")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Statutes taken in by a stream, in two waves of files: the collection holds all their passages."""
    name = _statute_collection(spark, "string")
    files, checkpoint = scratch_dir(spark, "waves"), scratch_dir(spark, "stream")
    texts = statute_texts(spark, sf).select("doc_id", "text")
    for wave in (0, 1):
        texts.where(F.col("doc_id") % 2 == wave).write.mode("append").parquet(files)
        stream = spark.readStream.schema(texts.schema).parquet(files)
        ingest.ingest_texts(stream, name, _letters, checkpoint).awaitTermination()
        collection.compact(spark, name)
    return collection.current(spark, name).select(*_long("doc_id"), *_pos_columns(), "text")


def _three_waves(spark: SparkSession, sf: str) -> tuple[str, ingest.Ledger]:
    """Statutes taken in by a stream in three waves, with replacements, removals and repetitions.

    First two thirds of the documents, half of these in a longer version, and
    documents that are removed later; then the last third and the versions that
    stay; then every document again, unchanged.
    """
    docs = documents_with_origin(spark, sf)
    third = F.col("doc_id") % 3
    final = statutes_of(docs)
    longer = statutes_of(docs.where(third == 0).withColumn("text", F.concat("text", F.lit(".\n"), "text")))
    brief = statutes_of(docs.where(F.col("doc_id") % 5 == 0)).withColumn("doc_id", -F.col("doc_id") - 1)
    waves = [
        longer.unionByName(final.where(third == 1)).unionByName(brief),
        final.where(third != 1),
        final.unionByName(brief.withColumn("text", F.lit(None).cast("string"))),
    ]
    name, ledger = _statute_collection(spark, "string"), ingest.Ledger.below(scratch_dir(spark, "ledger"))
    files, checkpoint = scratch_dir(spark, "waves"), scratch_dir(spark, "stream")
    for wave in waves:
        wave.write.mode("append").parquet(files)
        stream = spark.readStream.schema(final.schema).parquet(files)
        ingest.ingest_changes(stream, name, ledger, _open_letter_model, checkpoint).awaitTermination()
    return name, ledger


def documents_with_origin(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")


def ingest_replacements(spark: SparkSession, sf: str) -> DataFrame:
    """After three waves the collection holds the last version's passages and no others."""
    name, _ = _three_waves(spark, sf)
    rows = collection.current(spark, name)
    return rows.select(*_long("doc_id"), *_pos_columns(), "text", F.size("dense").cast("bigint").alias("dim"))


def ingest_model(spark: SparkSession, sf: str) -> DataFrame:
    """After three waves the summed counts give the model of the passages that are left."""
    _, ledger = _three_waves(spark, sf)
    model = changes.model(spark, ledger.counts)
    return model.vocab.select("term", "df", r6("idf").alias("idf"))


def _open_overlap_model():
    """Stand-in for a cross-encoder: words of the question that the passage holds, by its length."""
    def score(pairs):
        return [len(set(q.split()) & set(t.split())) / (1 + len(t)) for q, t in pairs]

    return score


def _stored_statutes(spark: SparkSession, sf: str, with_model: bool = True) -> retrieve.StoredCollection:
    """The statutes' passages in a collection, indexed."""
    name = _statute_collection(spark, "bigint")
    collection.upsert(build_points(_statute_chunks(spark, sf), _letters(), None), name)
    points = collection.current(spark, name)
    model = lexical.fit(points.select("text")) if with_model else None
    return retrieve.index_collection(points, scratch_dir(spark, "index"), model)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _told(found: DataFrame) -> DataFrame:
    about = F.parse_json("metadata")
    return found.select(
        F.col("query_id").alias("item_id"), "rank", "id", "total_score", "sparse_score", "dense_score", "text",
        *[F.try_variant_get(about, f"$.{c}", kind).alias(c) for c, kind in (
            ("document_title", "string"), ("article_number", "bigint"), ("clause_number", "bigint"), ("point", "string"),
        )],
    )


def retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Passages with their metadata, from the stored collection alone."""
    return _told(retrieve.retrieve(_stored_statutes(spark, sf), _questions(spark, sf), _open_letter_model))


def retrieve_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The same without a lexical model: vectors alone, above the threshold."""
    stored = _stored_statutes(spark, sf, with_model=False)
    return _told(retrieve.retrieve(stored, _questions(spark, sf), _open_letter_model))


def retrieve_reranked(spark: SparkSession, sf: str) -> DataFrame:
    """The best five of twenty candidates by a model of pairs."""
    found = retrieve.retrieve(
        _stored_statutes(spark, sf), _questions(spark, sf), _open_letter_model, open_reranker=_open_overlap_model
    )
    return found.select(F.col("query_id").alias("item_id"), "rank", "id", r6("total_score").alias("total_score"))


# --- citations --------------------------------------------------------------

_HIT = ("rank", "doc_id", "article_number", "clause_number", "point", "text")


def _code(spark: SparkSession, sf: str) -> DataFrame:
    """The code's chunks, written: keys and payload are read from them apart."""
    return written(code_chunks(spark, sf), "chunks")


def lookup_direct(spark: SparkSession, sf: str) -> DataFrame:
    return citation.lookup_direct(direct_requests(spark, sf), _code(spark, sf)).select("req_id", *_HIT)


def lookup_inbound(spark: SparkSession, sf: str) -> DataFrame:
    return citation.lookup_inbound(supplier_requests(spark, sf), _code(spark, sf)).select("req_id", *_HIT)


def _by_index(lookup: Callable, requests: Callable) -> Query:
    """The same look-up from a stored index."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        name = "code_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
        return lookup(requests(spark, sf), citation_index.build(code_chunks(spark, sf), name)).select("req_id", *_HIT)

    return run


def lookup_outbound(spark: SparkSession, sf: str) -> DataFrame:
    return citation.lookup_outbound(supplier_requests(spark, sf), _code(spark, sf)).select("req_id", *_HIT)


# --- context and tool calls -------------------------------------------------

def format_records(spark: SparkSession, sf: str) -> DataFrame:
    requests = direct_requests(spark, sf)
    return context.format_records(requests, citation.lookup_direct(requests, _code(spark, sf)))


def _chunk_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark queries, and the statute chunks found for them."""
    pos = [F.lpad(c.cast("string"), 6, "0") for c in (F.col("chunk_pos")[n] for n in (
        "chapter", "article", "clause", "point"))]
    chunks = written(
        _statute_chunks(spark, sf).withColumn(
            "key", F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 12, "0"), *pos)
        ),
        "chunks",
    )
    bench = table(spark, sf, "benchmark").select("item_id", "text")
    counts = written(lexical.term_counts(chunks, "key"), "counts")
    sides = lexical.search_vectors(counts, bench, _model_for(counts, bench), "key", "item_id")
    found = written(search.sparse_search(*sides), "found")
    return bench.withColumnRenamed("item_id", "query_id"), search.with_payload(found, chunks, "key")


def format_context(spark: SparkSession, sf: str) -> DataFrame:
    bench, results = _chunk_results(spark, sf)
    return context.format_context(bench, results)


def rag_prompt(spark: SparkSession, sf: str) -> DataFrame:
    bench, results = _chunk_results(spark, sf)
    cited = context.format_context(bench, results).join(bench, "query_id")
    return cited.select(
        "query_id", context.rag_prompt(F.col("context"), F.col("text")).alias("prompt")
    )


def conversation_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The last user turn is the question, passages found for it the context; what stands before it is the history."""
    conv = table(spark, sf, "conversations")
    last = conv.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    asked = conv.join(last, "conv_id")
    questions = asked.where("turn = last and role = 'user'").select(F.col("conv_id").alias("query_id"), "text")
    found = retrieve.retrieve(_stored_statutes(spark, sf), questions, _open_letter_model)
    cited = context.format_context(questions, retrieve.with_citation(found)).join(questions, "query_id")
    prompts = cited.select(
        F.col("query_id").alias("conv_id"), context.rag_prompt(F.col("context"), F.col("text")).alias("content")
    )
    history = asked.where("turn < last").withColumnRenamed("text", "content")
    m = context.messages(last.select("conv_id"), prompts, history)
    return m.select("conv_id", F.col("part").cast("bigint").alias("part"), "turn", "role", "content")


def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls = toolcalls.check_calls(toolcalls.extract_calls(responses(spark, sf)))
    return calls.select(
        "resp_id", "call_id", "name", "known", "callable", "document", "article", "clause", "point"
    )


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    checked = toolcalls.check_calls(toolcalls.extract_calls(responses(spark, sf)))
    return checked, toolcalls.resolve_calls(checked, _code(spark, sf))


def tool_call_status(spark: SparkSession, sf: str) -> DataFrame:
    return toolcalls.call_log(*_resolved(spark, sf)).select(
        "resp_id", "call_id", "name", "status", "results_count", "error"
    )


def tool_call_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    return toolcalls.follow_up(*_resolved(spark, sf))


def tool_call_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = toolcalls.follow_up_messages(responses(spark, sf), tool_call_follow_up(spark, sf))
    return m.select("resp_id", F.col("part").cast("bigint").alias("part"), "turn", "role", "content")


def answer_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per supplier's response: passages found for its question, its name standing for the answer.

    The question is a benchmark text, by the supplier's number.
    """
    questions = _questions(spark, sf)
    n = questions.select(F.count("*")).scalar()
    asked = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("resp_id"), F.col("s_name").alias("answer"), (F.col("s_suppkey") % n).alias("query_id")
    )
    found = written(retrieve.retrieve(_stored_statutes(spark, sf), questions, _open_letter_model), "found")
    docs = asked.select("resp_id", "query_id").join(found, "query_id").drop("query_id")
    return toolcalls.answer_records(asked.select("resp_id", "answer"), docs, toolcalls.call_log(*_resolved(spark, sf)))


# --- points -----------------------------------------------------------------

def _document_points(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents as points: stand-in embedding and sparse vector."""
    d = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    counts = written(lexical.term_counts(d, "chunk_id"), "counts")
    model = lexical.with_term_ids(lexical.fit(counts))
    return build_points(d, dense.embed(F.col("text"), _open_letter_model), model, counts=counts)


def points_build(spark: SparkSession, sf: str) -> DataFrame:
    p = _document_points(spark, documents(spark, sf))
    return p.select(
        "chunk_id", F.size("dense").cast("bigint").alias("dim"),
        F.size("sparse.indices").cast("bigint").alias("n_terms"),
        F.array_min("sparse.indices").alias("first_id"),
        F.array_max("sparse.indices").alias("last_id"),
        F.round(F.aggregate("sparse.values", F.lit(0.0), lambda a, x: a + x), 5).alias("weight"),
    )


def points_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, then the labelled ones again as a new version, then compacted."""
    docs = documents(spark, sf)
    labels = table(spark, sf, "labels")
    name = "points_upsert_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
    columns = "chunk_id string, text string, dense array<float>"

    def rows(df: DataFrame) -> DataFrame:
        d = df.select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
        return d.withColumn("dense", dense.embed(F.col("text"), _open_letter_model))

    collection.ensure_collection(
        spark, name, dim=len(LETTERS), location=scratch_dir(spark, "points"), columns=columns
    )
    collection.upsert(rows(docs), name)
    newer = docs.join(labels, "doc_id", "left_semi").withColumn(
        "text", F.concat(F.lit("v2 "), "text")
    )
    collection.upsert(rows(newer), name)
    collection.upsert(rows(newer), name)
    collection.compact(spark, name)
    return collection.current(spark, name).select("chunk_id", "text")


QUERIES: dict[str, Query] = {
    "token_stats": token_stats,
    "bm25_corpus_stats": bm25_corpus_stats,
    "bm25_vocab": bm25_vocab,
    "bm25_sparse_vectors": bm25_sparse_vectors,
    "bm25_pair_score": bm25_pair_score,
    "sparse_topk": sparse_topk,
    "dense_topk": dense_topk,
    "dense_threshold": dense_threshold,
    "dense_dot": _dense_metric("dot"),
    "dense_euclid": _dense_metric("euclid"),
    "dense_manhattan": _dense_metric("manhattan"),
    "vector_normalize": vector_normalize,
    "embed_documents": embed_documents,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_dense_fallback": hybrid_dense_fallback,
    "rerank_bm25": rerank_bm25,
    "chunk_lengths": chunk_lengths,
    "length_summary": length_summary,
    "length_histogram": length_histogram,
    "length_density": length_density,
    "preamble_lines": preamble_lines,
    "parse_documents": parse_documents,
    "parse_articles": parse_articles,
    "parse_clauses": parse_clauses,
    "parse_points": parse_points,
    "chunk_clauses": _of_kind("clause", *_LINEAGE),
    "chunk_points": _of_kind("point", *_LINEAGE),
    "chunk_legal_basis": _of_kind(
        "legal_basis", "document_title", "type", "chapter_total", "article_total"
    ),
    "chunk_code": chunk_code,
    "lookup_direct": lookup_direct,
    "lookup_inbound": lookup_inbound,
    "lookup_outbound": lookup_outbound,
    "format_records": format_records,
    "format_context": format_context,
    "rag_prompt": rag_prompt,
    "conversation_messages": conversation_messages,
    "tool_calls": tool_calls,
    "tool_call_status": tool_call_status,
    "tool_call_follow_up": tool_call_follow_up,
    "tool_call_messages": tool_call_messages,
    "answer_records": answer_records,
    "points_build": points_build,
    "points_upsert": points_upsert,
    "collection_sparse_topk": collection_sparse_topk,
    "segmented_tokens": segmented_tokens,
    "model_round_trip": model_round_trip,
    "chunk_ids": chunk_ids,
    "texts_round_trip": texts_round_trip,
    "documents_json_round_trip": documents_json_round_trip,
    "documents_json_lines_round_trip": documents_json_lines_round_trip,
    "collection_scan": collection_scan,
    "stream_ingest": stream_ingest,
    "dense_index_cosine": _indexed("cosine", 14),
    "dense_index_euclid": _indexed("euclid", 7),
    "block_max_topk": block_max_topk,
    "ingest_replacements": ingest_replacements,
    "ingest_model": ingest_model,
    "index_lookup_direct": _by_index(citation.lookup_direct, direct_requests),
    "index_lookup_inbound": _by_index(citation.lookup_inbound, supplier_requests),
    "index_lookup_outbound": _by_index(citation.lookup_outbound, supplier_requests),
    "retrieve_hybrid": retrieve_hybrid,
    "retrieve_dense": retrieve_dense,
    "retrieve_reranked": retrieve_reranked,
    "parse_blocks_points": parse_blocks_points,
    "parse_blocks_clauses": parse_blocks_clauses,
    "preamble_split": preamble_split,
    "chunk_hard": chunk_hard,
    "chunk_defaults": chunk_defaults,
    "collection_recreated": collection_recreated,
}
