"""Fixed schemas. Numbers are bigint: a run of digits in a text may be long."""

from __future__ import annotations

REFERENCE = "struct<document:string,article:bigint,clause:bigint,point:string>"
REFERENCES = f"array<{REFERENCE}>"
POINT = f"struct<point:string,content:string,references:{REFERENCES}>"
CLAUSE = (
    f"struct<clause_number:bigint,content:string,references:{REFERENCES},points:array<{POINT}>>"
)
ARTICLE = (
    "struct<article_number:bigint,article_title:string,category:string,"
    f"clauses:array<{CLAUSE}>>"
)
CHAPTER = f"struct<chapter_number:bigint,chapter_title:string,articles:array<{ARTICLE}>>"
CHAPTERS = f"array<{CHAPTER}>"

# A parsed document: one row per document.
TREE = f"document_title string, legal_basis string, chapters {CHAPTERS}"

CHUNK_POS = "struct<chapter:bigint,article:bigint,clause:bigint,point:bigint>"

CHUNK_COLUMNS = [
    "chunk_id", "doc_id", "chunk_pos", "chunk_kind", "text", "document_title",
    "chapter_number", "chapter_title", "article_number", "article_title",
    "article_category", "clause_number", "point", "is_point", "references",
    "type", "chapter_total", "article_total",
]

# Arguments a look-up accepts, as JSON and as a request row.
LOOKUP_ARGS = "document string, article bigint, clause bigint, point string"
