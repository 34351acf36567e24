"""Chunking: one retrievable passage per point, bare clause and legal basis.

The nested form (``chunk_documents``) is one chain of explodes over the tree,
so parse and chunk together are a single map over the corpus. The flat form
(``chunk_flat``) takes clause and point tables, for corpora kept relationally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawspark.functions.text import strip
from lawspark.schemas import CHUNK_COLUMNS, REFERENCES

# Wording of passages, defaults and markers.
UNTITLED_DOCUMENT = "Untitled Document"
UNTITLED_CHAPTER = "No Title"
CLAUSE_INTRO = "Khung hình phạt/Quy định: "
POINT_INTRO = "Chi tiết ("
BASIS_INTRO = "Căn cứ pháp lý của văn bản:\n"
BASIS_TYPE = "legal_basis"
WHOLE_CLAUSE = "-1"


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _references(col: Column) -> Column:
    return F.coalesce(col, F.array().cast(REFERENCES))


def chunk_id(doc_id: Column, pos: Column) -> Column:
    """The same passage of the same document gets the same id in every run."""
    place = [pos[n].cast("string") for n in ("chapter", "article", "clause", "point")]
    return F.sha2(F.concat_ws("/", doc_id.cast("string"), *place), 256)


def _shape(slots: DataFrame) -> DataFrame:
    """Slots (legal basis, bare clause or point) to chunk rows."""
    basis = F.col("slot") == "basis"
    point = F.col("slot") == "point"
    clause_text, point_text = strip(_text("clause_content")), strip(_text("point_content"))
    title = _text("article_title")
    text = (
        F.when(basis, F.concat(F.lit(BASIS_INTRO), _text("legal_basis")))
        .when(
            point,
            F.concat(
                title, F.lit("\n"),
                F.when(clause_text != "", F.concat(F.lit(CLAUSE_INTRO), clause_text, F.lit("\n")))
                .otherwise(""),
                F.lit(POINT_INTRO), _text("point_label"), F.lit("): "), point_text,
            ),
        )
        .otherwise(F.concat(title, F.lit("\n"), clause_text))
    )
    own, above = _references(F.col("point_references")), _references(F.col("clause_references"))
    references = (
        F.when(basis, F.array().cast(REFERENCES))
        .when(point & (F.size(own) > 0), own)
        .otherwise(above)
    )
    keep = (
        F.when(basis, _text("legal_basis") != "")
        .when(point, point_text != "")
        .otherwise(clause_text != "")
    )

    def unless_basis(value: Column) -> Column:
        return F.when(~basis, value)

    shaped = slots.where(keep).select(
        chunk_id(F.col("doc_id"), F.col("chunk_pos")).alias("chunk_id"),
        "doc_id",
        "chunk_pos",
        F.when(basis, BASIS_TYPE).otherwise(F.col("slot")).alias("chunk_kind"),
        text.alias("text"),
        _text("document_title", UNTITLED_DOCUMENT).alias("document_title"),
        unless_basis(F.col("chapter_number")).alias("chapter_number"),
        unless_basis(_text("chapter_title", UNTITLED_CHAPTER)).alias("chapter_title"),
        unless_basis(F.col("article_number")).alias("article_number"),
        unless_basis(title).alias("article_title"),
        unless_basis(_text("category")).alias("article_category"),
        unless_basis(F.col("clause_number")).alias("clause_number"),
        F.when(point, _text("point_label")).when(~basis, WHOLE_CLAUSE).alias("point"),
        unless_basis(point).alias("is_point"),
        references.alias("references"),
        F.when(basis, BASIS_TYPE).alias("type"),
        F.when(basis, F.col("chapter_total")).alias("chapter_total"),
        F.when(basis, F.col("article_total")).alias("article_total"),
    )
    return shaped.select(*CHUNK_COLUMNS)


def _pos(*parts: Column) -> Column:
    names = ("chapter", "article", "clause", "point")
    return F.struct(*[
        F.coalesce(p.cast("bigint"), F.lit(-1).cast("bigint")).alias(n)
        for n, p in zip(names, parts, strict=True)
    ])


def chunk_documents(tree: DataFrame) -> DataFrame:
    """Parsed documents (``doc_id`` + tree) to chunks.

    The legal basis rides as one more chapter slot at the end, so that each
    document is parsed and walked once and its chunk comes last.
    """
    chapters = F.coalesce("chapters", F.expr("array()").cast(_type_of(tree, "chapters")))
    docs = tree.select(
        "doc_id", "document_title", "legal_basis",
        F.size(chapters).cast("bigint").alias("chapter_total"),
        F.aggregate(
            chapters, F.lit(0).cast("bigint"),
            lambda n, c: n + F.size(F.coalesce(c["articles"], F.array())),
        ).alias("article_total"),
        F.concat(chapters, F.array(F.lit(None).cast(_element(tree, "chapters")))).alias("slots"),
    )
    lineage = ["doc_id", "document_title", "legal_basis", "chapter_total", "article_total"]
    # Outer: the inner form adds a filter on the tree's size, and would parse twice.
    ch = docs.select(*lineage, F.posexplode_outer("slots").alias("chapter_pos", "c")).withColumn(
        "basis", F.col("chapter_pos") == F.col("chapter_total")
    )
    art = ch.select(
        *lineage, "basis", "chapter_pos",
        F.col("c.chapter_number"), F.col("c.chapter_title"),
        F.posexplode_outer("c.articles").alias("article_pos", "a"),
    )
    cl = art.select(
        *lineage, "basis", "chapter_pos", "chapter_number", "chapter_title", "article_pos",
        F.col("a.article_number"), F.col("a.article_title"), F.col("a.category"),
        F.posexplode_outer("a.clauses").alias("clause_pos", "k"),
    ).where(F.col("basis") | F.col("k").isNotNull())
    pt = cl.select(
        *[c for c in cl.columns if c not in ("k",)],
        F.col("k.clause_number"), F.col("k.content").alias("clause_content"),
        F.col("k.references").alias("clause_references"),
        F.posexplode_outer("k.points").alias("point_pos", "p"),
    )
    return _shape(
        pt.select(
            *lineage, "chapter_number", "chapter_title", "article_number", "article_title",
            "category", "clause_number", "clause_content", "clause_references",
            F.col("p.point").alias("point_label"),
            F.col("p.content").alias("point_content"),
            F.col("p.references").alias("point_references"),
            F.when(F.col("basis"), "basis")
            .when(F.col("point_pos").isNotNull(), "point")
            .otherwise("clause").alias("slot"),
            _pos(*[F.col(f"{n}_pos") for n in ("chapter", "article", "clause", "point")])
            .alias("chunk_pos"),
        )
    )


def chunk_flat(clauses: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Clause and point tables to the same chunks, joined on the clause ``keys``.

    ``clauses``: keys, ``doc_id``, ``document_title``, chapter and article
    columns, ``category``, ``clause_number``, ``content``, ``references`` and
    the positions ``chapter_pos``, ``article_pos``, ``clause_pos``.
    ``points``: keys, ``point_pos``, ``point``, ``content``, ``references``.
    """
    p = points.select(
        *keys, "point_pos",
        F.col("point").alias("point_label"),
        F.col("content").alias("point_content"),
        F.col("references").alias("point_references"),
    )
    rows = (
        clauses.withColumnRenamed("content", "clause_content")
        .withColumnRenamed("references", "clause_references")
        .join(p, keys, "left")
    )
    none = F.lit(None)
    return _shape(
        rows.select(
            "doc_id", "document_title", "chapter_number", "chapter_title", "article_number",
            "article_title", "category", "clause_number", "clause_content", "clause_references",
            "point_label", "point_content", "point_references",
            none.cast("string").alias("legal_basis"),
            none.cast("bigint").alias("chapter_total"),
            none.cast("bigint").alias("article_total"),
            F.when(F.col("point_pos").isNotNull(), "point").otherwise("clause").alias("slot"),
            _pos(*[F.col(f"{n}_pos") for n in ("chapter", "article", "clause", "point")])
            .alias("chunk_pos"),
        )
    )


def _type_of(df: DataFrame, name: str):
    return df.schema[name].dataType


def _element(df: DataFrame, name: str):
    return df.schema[name].dataType.elementType
