"""Statute parsing: text to a tree of chapters, articles, clauses and points.

One text is one row, so all of its structure is found inside the row: each line
is tagged with a one-letter class, and the tagged text is cut at chapter,
section, article, clause and point lines in turn. Every step is a built-in
function that is linear in the text; the job is a map over the corpus, with no
shuffle, and runs in a streaming query as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawspark.functions.text import WS, let, lines, roman_to_int
from lawspark.schemas import CHAPTERS, REFERENCES

# What marks the parts of a statute.
BODY_MARK = "Chương I"
BASIS_STARTS = ("Căn cứ", "Theo đề nghị", "Chính phủ ban hành")
TITLE_MARKS = ("NGHỊ ĐỊNH", "QUY ĐỊNH XỬ PHẠT")
CHAPTER_LINE = rf"(?iu)Chương[{WS}]+([IVXLCDM]+)"
SECTION_LINE = rf"(?iu)Mục[{WS}]+\p{{Nd}}+\.[{WS}]+"
ARTICLE_LINE = rf"(?iu)Điều[{WS}]+(\p{{Nd}}+)\.[{WS}]+"
CLAUSE_LINE = rf"(\p{{Nd}}+)\.[{WS}]+"
POINT_LINE = rf"(?iu)([a-zđ]+)\)[{WS}]+"

# Line classes, first match wins. Every line is stored as "\n" + class + line.
# The pattern is only tried on lines with one of the starts and with the sign.
_CLASSES = (
    ("C", CHAPTER_LINE, ("C", "c"), None),
    ("S", SECTION_LINE, ("M", "m"), "."),
    ("A", ARTICLE_LINE, ("Đ", "đ"), "."),
    ("K", CLAUSE_LINE, (), "."),
    ("P", POINT_LINE, (), ")"),
)
_TEXT = "X"


def _any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def split_preamble(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``preamble`` and ``body``: both are the whole text without the mark."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = F.instr(text, BODY_MARK)
    return docs.select(
        *[c for c in docs.columns if c != text_col],
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("preamble"),
        F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text).alias("body"),
    )


def _is_basis(line: Column) -> Column:
    return _any_of([line.startswith(s) for s in BASIS_STARTS])


def legal_basis(preamble_lines: Column) -> Column:
    return F.array_join(F.filter(preamble_lines, _is_basis), "\n")


def document_title(preamble_lines: Column) -> Column:
    def is_title(line: Column) -> Column:
        return ~_is_basis(line) & _any_of([line.contains(m) for m in TITLE_MARKS])

    return F.array_join(F.filter(preamble_lines, is_title), " ")


def line_class(line: Column) -> Column:
    """The letter of a line, by itself."""
    cls = F.lit(_TEXT)
    for letter, pattern, starts, sign in reversed(_CLASSES):
        fits = line.rlike("^" + pattern)
        if sign:
            fits = line.contains(sign) & fits
        if starts:
            fits = _any_of([line.startswith(x) for x in starts]) & fits
        cls = F.when(fits, F.lit(letter)).otherwise(cls)
    return cls


def _tag(line: Column) -> Column:
    return F.concat(F.lit("\n"), line_class(line), line)


def tagged_body(body: Column) -> Column:
    """All lines with their class; the line after a chapter line becomes ``T``.

    The replacement runs from left to right and takes a chapter line together
    with the line after it, so that a second chapter line in a row is a title.
    """
    tagged = F.array_join(F.transform(lines(body), _tag), "")
    return F.regexp_replace(tagged, "\nC([^\n]*)\n.([^\n]*)", "\nC$1\nT$2")


def _cut(text: Column, classes: str) -> Column:
    """Segments that begin with a line of these classes; before them what precedes the first, perhaps nothing.

    The break is part of the match and put back: a bare look-ahead is tried in full at each character.
    """
    return F.transform(
        F.split(text, f"\n(?=[{classes}])"), lambda x, i: F.when(i > 0, F.concat(F.lit("\n"), x)).otherwise(x)
    )


def _settle(segment: Column) -> Column:
    """Put the content of an article before the headings that follow it.

    A chapter or section line does not close the article above it. Text before
    the first article belongs to nothing and is left out.
    """
    article = segment.startswith("\nA")
    has_heading = _any_of([segment.contains(f"\n{c}") for c in "CTS"])
    headings = F.regexp_replace(segment, "\n[AKPX][^\n]*", "")
    content = F.regexp_replace(segment, "\n[CTS][^\n]*", "")
    return F.when(article & ~has_heading, segment).when(article, F.concat(content, headings)).otherwise(headings)


def settled_body(tagged: Column) -> Column:
    return F.array_join(F.transform(_cut(tagged, "A"), _settle), "")


_ALL = (1 << 31) - 1


def _first(seg: Column) -> Column:
    """The first line of a segment, with its break and class."""
    return F.substring_index(seg, "\n", 2)


def _rest(seg: Column, first: Column) -> Column:
    return F.substring(seg, F.length(first) + 1, F.lit(_ALL))


def _number(line: Column, pattern: str) -> Column:
    return F.regexp_extract(line, pattern, 1).try_cast("bigint")


def _joined(seg: Column, first: Column, head: str) -> Column:
    """Text after the opening mark, later lines appended with a blank."""
    return F.concat(F.regexp_replace(first, head, ""), F.regexp_replace(_rest(seg, first), "\n.", " "))


def _point(seg: Column) -> Column:
    head = "^\nP" + POINT_LINE
    return let(_first(seg), lambda first: F.struct(
        F.regexp_extract(first, head, 1).alias("point"),
        _joined(seg, first, head).alias("content"),
        F.lit(None).cast(REFERENCES).alias("references"),
    ))


def _clause(seg: Column) -> Column:
    mark = "^\nK" + CLAUSE_LINE

    def of(parts: Column, head: Column, first: Column) -> Column:
        numbered = first.startswith("\nK")
        return F.struct(
            F.when(numbered, _number(first, mark)).otherwise(F.lit(0).cast("bigint")).alias("clause_number"),
            F.when(numbered, _joined(head, first, mark)).otherwise(_joined(head, first, "^\nI")).alias("content"),
            F.lit(None).cast(REFERENCES).alias("references"),
            F.transform(F.filter(parts, lambda p: p.startswith("\nP")), _point).alias("points"),
        )

    return let(_cut(seg, "P"), lambda parts: let(
        F.get(parts, F.lit(0)), lambda head: let(_first(head), lambda first: of(parts, head, first))
    ))


def _article(seg: Column, category: Column) -> Column:
    def clauses(content: Column) -> Column:
        # Content that does not open with a numbered clause is the implicit clause 0.
        implicit = content.startswith("\nP") | content.startswith("\nX")
        marked = F.when(implicit, F.concat(F.lit("\nI"), F.substring(content, 3, _ALL))).otherwise(content)
        return F.transform(F.array_remove(_cut(marked, "KI"), ""), _clause)

    return let(_first(seg), lambda first: F.struct(
        _number(first, "^\nA" + ARTICLE_LINE).alias("article_number"),
        F.substring(first, 3, _ALL).alias("article_title"),
        category.alias("category"),
        let(_rest(seg, first), clauses).alias("clauses"),
    ))


def _chapter(seg: Column) -> Column:
    def of_section(section: Column) -> Column:
        category = F.when(section.startswith("\nS"), F.substring(_first(section), 3, _ALL))
        return let(category, lambda own: F.transform(
            F.filter(_cut(section, "A"), lambda a: a.startswith("\nA")), lambda a: _article(a, own)
        ))

    return F.struct(
        roman_to_int(F.regexp_extract(_first(seg), "^\nC" + CHAPTER_LINE, 1)).alias("chapter_number"),
        F.regexp_extract(F.substring_index(seg, "\n", 3), "^\nC[^\n]*\nT([^\n]*)", 1).alias("chapter_title"),
        F.flatten(F.transform(_cut(seg, "S"), of_section)).alias("articles"),
    )


def parse_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, text, …)`` to ``(doc_id, …, document_title, legal_basis, chapters)``.

    Articles before the first chapter are left out with all they hold.
    """
    kept = [c for c in docs.columns if c != text_col]
    cut = split_preamble(docs, text_col)
    split = cut.select(
        *kept,
        lines(F.col("preamble")).alias("__preamble"),
        tagged_body(F.col("body")).alias("__tagged"),
    )
    settled = split.select(*kept, "__preamble", settled_body(F.col("__tagged")).alias("__settled"))
    chapters = F.transform(
        F.filter(_cut(F.col("__settled"), "C"), lambda s: s.startswith("\nC")), _chapter
    )
    return settled.select(
        *kept,
        document_title(F.col("__preamble")).alias("document_title"),
        legal_basis(F.col("__preamble")).alias("legal_basis"),
        chapters.cast(CHAPTERS).alias("chapters"),
    )


def explode_articles(tree: DataFrame) -> DataFrame:
    """One row per article: ``doc_id, chapter_pos, chapter_number, …, clauses``."""
    # Outer: the inner form adds a filter on the tree's size, and would parse twice.
    ch = tree.select("doc_id", F.posexplode_outer("chapters").alias("chapter_pos", "c")).where(
        F.col("chapter_pos").isNotNull()
    )
    art = ch.select(
        "doc_id", "chapter_pos", F.col("c.chapter_number"), F.col("c.chapter_title"),
        F.posexplode("c.articles").alias("article_pos", "a"),
    )
    return art.select(
        "doc_id", "chapter_pos", "chapter_number", "chapter_title", "article_pos", "a.*"
    )


def explode_clauses(tree: DataFrame) -> DataFrame:
    """One row per clause, keyed by positions."""
    cl = explode_articles(tree).select(
        "doc_id", "chapter_pos", "article_pos", "article_number",
        F.posexplode("clauses").alias("clause_pos", "k"),
    )
    return cl.select("doc_id", "chapter_pos", "article_pos", "article_number", "clause_pos", "k.*")


def explode_points(tree: DataFrame) -> DataFrame:
    """One row per point, keyed by positions."""
    p = explode_clauses(tree).select(
        "doc_id", "chapter_pos", "article_pos", "article_number", "clause_pos", "clause_number",
        F.posexplode("points").alias("point_pos", "p"),
    )
    return p.select(
        "doc_id", "chapter_pos", "article_pos", "article_number", "clause_pos", "clause_number",
        "point_pos", "p.*",
    )
