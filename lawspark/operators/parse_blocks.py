"""Parsing of statutes too long for one row or task: blocks of lines, joined by prefix scans.

``blocks(doc_id, block, text)`` hold whole lines, in the order of ``block``.
Lines are rows. What a line means depends on all before it only through a few
numbers: whether a chapter line still waits for its title, how many chapters,
articles, content lines, clauses and points there were, and some of these as
they stood at the last chapter, article or clause. Each is counted inside the
block, summed up per block, and carried over the blocks of a document by a
window over one narrow row a block: once for titles, once for headings, once
for clauses and points. So no task sees more than a block of lines,
and a document's blocks are parsed side by side. The results are those of
``parse.explode_articles``, ``explode_clauses`` and ``explode_points``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawspark.functions.text import lines, roman_to_int
from lawspark.operators.parse import ARTICLE_LINE, BODY_MARK, CHAPTER_LINE, CLAUSE_LINE, POINT_LINE, _number, line_class
from lawspark.session import written

_BLOCK = ["doc_id", "block"]

def _inside():
    return Window.partitionBy(*_BLOCK).orderBy("i")


def _so_far():
    return _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _blocks():
    return Window.partitionBy("doc_id").orderBy("block")


def _earlier():
    return _blocks().rowsBetween(Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Parts:
    articles: DataFrame
    clauses: DataFrame
    points: DataFrame


def cut(docs: DataFrame, size: int = 50, text_col: str = "text") -> DataFrame:
    """Texts as blocks of ``size`` lines; for tests and for texts that still fit a row."""
    all_lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    starts = F.sequence(F.lit(1), F.greatest(F.size(all_lines), F.lit(1)), F.lit(size))
    parts = F.transform(starts, lambda at: F.array_join(F.slice(all_lines, at, F.lit(size)), "\n"))
    return docs.select("doc_id", F.posexplode(parts).alias("block", "text"))


def _body_lines(blocks: DataFrame) -> DataFrame:
    """``doc_id, block, i, line, class`` of the body: from the first mark on, or everything without one."""
    marked = blocks.select("doc_id", "block", F.coalesce("text", F.lit("")).alias("text"))
    marked = written(marked.withColumn("at", F.instr("text", BODY_MARK)), "blocks")  # read for the first mark, then for the lines
    first = marked.where("at > 0").groupBy("doc_id").agg(F.min("block").alias("first"))
    body = marked.join(first, "doc_id", "left").where("first is null or block >= first")
    text = F.when(F.col("block") == F.col("first"), F.substring("text", F.col("at"), F.length("text"))).otherwise(F.col("text"))
    rows = body.select(*_BLOCK, F.posexplode_outer(lines(text)).alias("i", "line")).where("line is not null")
    return rows.withColumn("class", line_class(F.col("line")))


def _followed(rows: DataFrame, flags: dict[str, Column], values: dict[str, tuple[Column, Column | str]]) -> DataFrame:
    """Add running counts and remembered values over the whole document, this line included.

    A flag gives the number of lines where it held. A value, ``(where, value)``,
    is that of the last line where the condition held; a flag's name stands for
    its count at that line. Inside the block counts start at 0; what the blocks
    before add up to is found on one narrow row a block, for counts and values
    alike, and joined once.
    """
    rows = rows.withColumns({f"__{n}": F.coalesce(f, F.lit(False)).cast("bigint") for n, f in flags.items()})
    rows = rows.withColumns({f"__{n}_own": F.sum(f"__{n}").over(_so_far()) for n in flags})
    held = {n: F.when(w, F.struct((F.col(f"__{v}_own") if isinstance(v, str) else v).alias("v"))) for n, (w, v) in values.items()}
    rows = rows.withColumns({f"__{n}_own": F.last(h, ignorenulls=True).over(_so_far()) for n, h in held.items()})

    def whole(name: str, v: Column | str) -> Column:
        """A value of this block, its count carried on from the blocks before."""
        c = F.col(name)
        return F.when(c.isNotNull(), F.struct((c["v"] + F.col(f"__{v}_base")).alias("v"))) if isinstance(v, str) else c

    per_block = rows.groupBy(*_BLOCK).agg(
        *[F.sum(f"__{n}").alias(f"__{n}_sum") for n in flags], *[F.max_by(f"__{n}_own", "i").alias(f"__{n}_end") for n in values]
    )
    per_block = per_block.withColumns({f"__{n}_base": F.coalesce(F.sum(f"__{n}_sum").over(_earlier()), F.lit(0)) for n in flags})
    carried = [F.last(whole(f"__{n}_end", v), ignorenulls=True).over(_earlier()).alias(f"__{n}_base") for n, (_, v) in values.items()]
    rows = rows.join(per_block.select(*_BLOCK, *[f"__{n}_base" for n in flags], *carried), _BLOCK)
    out = {n: F.col(f"__{n}_own") + F.col(f"__{n}_base") for n in flags}
    out |= {n: F.coalesce(whole(f"__{n}_own", v), F.col(f"__{n}_base"))["v"] for n, (_, v) in values.items()}
    return rows.withColumns(out).drop(*[f"__{n}{x}" for n in [*flags, *values] for x in ("", "_own", "_base")])


def _titled(rows: DataFrame) -> DataFrame:
    """Tell chapter lines from titles: each chapter line in a row flips whether a title is due, any other line ends it."""
    other = F.col("class") != "C"
    rows = rows.withColumn("__stop", F.last(F.when(other, F.col("i")), ignorenulls=True).over(_inside().rowsBetween(Window.unboundedPreceding, -1)))
    per_block = rows.groupBy(*_BLOCK).agg(
        F.max(F.when(other, F.col("i"))).alias("stop"), F.max("i").alias("last"), F.count("*").alias("n")
    )
    # A block of chapter lines only passes the state on, flipped by each; any other sets it.
    odd = ((F.col("last") - F.coalesce("stop", F.lit(-1))) % 2).cast("bigint")
    odd = F.when(F.col("stop").isNull(), F.col("n") % 2).otherwise(odd)
    flips = F.sum(F.when(F.col("stop").isNull(), odd).otherwise(0)).over(_blocks().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    state = per_block.withColumn("odd", odd).withColumn("flips", flips)
    set_to = F.last(F.when(F.col("stop").isNotNull(), F.struct("odd", "flips")), ignorenulls=True).over(_earlier())
    due = (F.coalesce(set_to["odd"], F.lit(0)) + F.coalesce(F.lag("flips").over(_blocks()), F.lit(0))
           - F.coalesce(set_to["flips"], F.lit(0))) % 2
    rows = rows.join(state.select(*_BLOCK, F.abs(due).alias("due")), _BLOCK)
    place = F.row_number().over(_inside()) - 1  # lines before this one in the block
    run = F.when(F.col("__stop").isNull(), place).otherwise(F.col("i") - F.col("__stop") - 1)
    waits = (F.when(F.col("__stop").isNull(), F.col("due")).otherwise(0) + run) % 2 == 1
    return rows.withColumn("class", F.when(waits, "T").otherwise(F.col("class"))).drop("__stop", "due")


def parse_blocks(blocks: DataFrame) -> Parts:
    """The articles, clauses and points of all documents, as ``parse`` gives them.

    ``articles(doc_id, chapter_pos, chapter_number, chapter_title, article_pos,
    article_number, article_title, category)``; ``clauses`` and ``points`` with
    the positions above them, their number or letter and their content. Chapters
    without articles are not listed. A null text has no lines.
    """
    is_ = lambda *classes: F.col("class").isin(*classes)
    # Written: each pass reads the lines twice, for what a block adds up to without their text.
    rows = _titled(written(_body_lines(blocks), "body"))
    content = is_("K", "P", "X")
    rows = _followed(
        rows, {"chapter": is_("C"), "article": is_("A"), "content": content},
        {
            "section": (is_("C", "S"), F.when(is_("S"), F.col("line"))),
            "above": (is_("C"), "article"),  # articles before the chapter
            "began": (is_("A"), "content"),  # content lines before the article
            "within": (is_("A"), "chapter"),  # the article's chapter
        },
    )
    # Content belongs to the last article, whatever headings stand between; its first line opens a clause.
    owned = content & (F.col("article") > 0)
    opens = owned & (is_("K") | (F.col("content") == F.col("began") + 1))
    rows = _followed(
        rows.withColumn("opens", opens), {"clause": F.col("opens"), "letter": owned & is_("P") & ~F.col("opens")},
        {"clause_base": (is_("A"), "clause"), "letter_base": (F.col("opens"), "letter")},
    )
    rows = written(rows.where((F.col("article") > 0) | is_("C", "T")), "lines")
    at = lambda *c: F.min_by(*c)

    chapters = rows.where(is_("C")).select("doc_id", "chapter", roman_to_int(F.regexp_extract("line", "^" + CHAPTER_LINE, 1)).alias("chapter_number"))
    titles = rows.where(is_("T")).groupBy("doc_id", "chapter").agg(at("line", F.struct("block", "i")).alias("chapter_title"))
    chapters = chapters.join(titles, ["doc_id", "chapter"], "left").withColumn("chapter_title", F.coalesce("chapter_title", F.lit("")))
    heads = rows.where(is_("A") & (F.col("within") > 0)).select(
        "doc_id", "article", F.col("within").alias("chapter"), (F.col("article") - F.col("above") - 1).alias("article_pos"),
        _number(F.col("line"), "^" + ARTICLE_LINE).alias("article_number"), F.col("line").alias("article_title"),
        F.col("section").alias("category"),
    )
    articles = heads.join(chapters, ["doc_id", "chapter"]).withColumn("chapter_pos", F.col("chapter") - 1).drop("chapter")

    inside = rows.where(is_("K", "P", "X") & (F.col("within") > 0)).select(
        "doc_id", "article", "block", "i", "line", "class", "opens",
        (F.col("clause") - F.col("clause_base") - 1).alias("clause_pos"),
        (F.col("letter") - F.col("letter_base") - 1).alias("point_pos"),
    )
    # What is gathered is one clause's opening or one point.
    pieces = inside.groupBy("doc_id", "article", "clause_pos", "point_pos").agg(
        F.array_sort(F.collect_list(F.struct("block", "i", "line", "class"))).alias("p"),
    ).withColumn("first", F.get("p", F.lit(0)))
    rest = F.array_join(F.concat(F.array(F.lit("")), F.transform(F.slice("p", 2, F.size("p")), lambda x: x["line"])), " ")
    numbered = F.col("first.class") == "K"
    opening = F.when(numbered, F.regexp_replace("first.line", "^" + CLAUSE_LINE, "")).otherwise(F.col("first.line"))
    places = articles.select("doc_id", "article", "chapter_pos", "article_pos", "article_number")
    keys = ["doc_id", "chapter_pos", "article_pos", "article_number", "clause_pos"]
    clause_number = F.when(numbered, _number(F.col("first.line"), "^" + CLAUSE_LINE)).otherwise(F.lit(0).cast("bigint"))
    openings = pieces.where("point_pos = -1").join(places, ["doc_id", "article"])
    clauses = openings.select(*keys, clause_number.alias("clause_number"), F.concat(opening, rest).alias("content"))
    letter = F.regexp_extract("first.line", "^" + POINT_LINE, 1)
    points = pieces.where("point_pos >= 0").join(places, ["doc_id", "article"]).select(
        *keys, "point_pos", letter.alias("point"),
        F.concat(F.regexp_replace("first.line", "^" + POINT_LINE, ""), rest).alias("content"),
    )
    points = points.join(clauses.select(*[c for c in keys if c != "article_number"], "clause_number"), [c for c in keys if c != "article_number"])
    return Parts(articles.drop("article"), clauses, points)
