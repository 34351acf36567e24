"""Hand-written texts and the trees they must give."""

import pytest

from lawspark.functions import text as tx
from lawspark.operators.parse import parse_documents

from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def parse(spark):
    def run(text):
        df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        return parse_documents(df).first().asDict(recursive=True)

    return run


def outline(tree):
    """(chapter, title, [(article, category, [(clause, content, [(point, content)])])])."""
    return [
        (c["chapter_number"], c["chapter_title"], [
            (a["article_number"], a["category"], [
                (k["clause_number"], k["content"], [(p["point"], p["content"]) for p in k["points"]])
                for k in a["clauses"]
            ]) for a in c["articles"]
        ]) for c in tree["chapters"]
    ]


def test_implicit_clause_even_if_it_looks_like_a_point(parse):
    t = parse("Chương I\nT\nĐiều 1. A\na) first\nb) second\ncont b")
    assert outline(t) == [(1, "T", [(1, None, [(0, "a) first", [("b", "second cont b")])])])]


def test_chapter_takes_the_next_line_as_title_whatever_it_is(parse):
    t = parse("Chương I\n\n \nx\nChương II\nChương III\nĐiều 4. z\nChương IV")
    assert outline(t) == [(1, "x", []), (2, "Chương III", [(4, None, [])]), (4, "", [])]


def test_text_after_a_heading_belongs_to_the_article_above(parse):
    t = parse("Chương I\nx\nĐiều 1. a\n1. one\nChương II\ny\n3. stray\nMục 1. S\nmore\nĐiều 2. b")
    assert outline(t) == [
        (1, "x", [(1, None, [(1, "one", []), (3, "stray more", [])])]),
        (2, "y", [(2, "Mục 1. S", [])]),
    ]


def test_section_is_reset_by_chapter(parse):
    t = parse("Chương I\nx\nMục 2. S\nĐiều 1. a\nĐiều 2. b\nChương II\ny\nĐiều 3. c")
    assert [(a["article_number"], a["category"]) for c in t["chapters"] for a in c["articles"]] == [
        (1, "Mục 2. S"), (2, "Mục 2. S"), (3, None)
    ]


def test_headings_without_text_are_continuation(parse):
    t = parse("Chương I\nx\nĐiều 1. a\n1. one\nĐiều 5.\nMục 1.\n2.\nb)")
    assert outline(t) == [(1, "x", [(1, None, [(1, "one Điều 5. Mục 1. 2. b)", [])])])]


def test_articles_before_any_chapter_are_dropped_with_their_content(parse):
    t = parse("Điều 9. before\n1. gone\nCHƯƠNG IV\nt\n2. gone too\nĐiều 1. y\n1. kept")
    assert outline(t) == [(4, "t", [(1, None, [(1, "kept", [])])])]


def test_preamble_title_and_basis(parse):
    t = parse(
        "CHÍNH PHỦ\nNGHỊ ĐỊNH\n Căn cứ NGHỊ ĐỊNH 1 \nTheo đề nghị của B\nQUY ĐỊNH XỬ PHẠT x\n"
        "căn cứ nhỏ\nxem Chương I\nt"
    )
    assert t["document_title"] == "NGHỊ ĐỊNH QUY ĐỊNH XỬ PHẠT x"
    assert t["legal_basis"] == "Căn cứ NGHỊ ĐỊNH 1\nTheo đề nghị của B"
    assert outline(t) == [(1, "t", [])]


def test_without_the_mark_preamble_and_body_are_the_whole_text(parse):
    t = parse("CHƯƠNG II\nNGHỊ ĐỊNH 5\nĐIỀU 3. q")
    assert t["document_title"] == "NGHỊ ĐỊNH 5"
    assert outline(t) == [(2, "NGHỊ ĐỊNH 5", [(3, None, [])])]


def test_case_labels_and_unicode_space(parse):
    for space in (" ", "\u00a0"):  # the mark has a plain blank; without it all is body
        t = parse(f"Chương{space}I\nx\nĐIỀU\u00a07.\u2003q\n1.\u00a0one\u3000\nĐ) up\nab) two\n\u2003đ) low")
        assert outline(t) == [
            (1, "x", [(7, None, [(1, "one", [("Đ", "up"), ("ab", "two"), ("đ", "low")])])])
        ]


def test_word_without_boundary_is_a_chapter(parse):
    assert outline(parse("Chương mới\nx"))[0][0] == 1000


def test_empty_and_null(parse):
    for text in ("", None, " \n "):
        t = parse(text)
        assert (t["document_title"], t["legal_basis"], t["chapters"]) == ("", "", [])


@pytest.mark.parametrize(
    "numeral,value", [("XIV", 14), ("mcmxc", 1990), ("IIX", 8), ("", 0), ("VQ", 5), ("CDXLIV", 444)]
)
def test_roman(spark, numeral, value):
    assert spark.range(1).select(tx.roman_to_int(F.lit(numeral))).first()[0] == value


def test_whitespace_sets_agree(spark):
    """The trimmed set, the pattern class and Python's str.isspace are the same."""
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, s string")
    got = df.select(
        "c", (tx.strip(F.col("s")) == "").alias("trimmed"), F.col("s").rlike(f"^[{tx.WS}]$").alias("cls")
    ).collect()
    want = {c for c in points if chr(c).isspace()}
    assert {r.c for r in got if r.trimmed} == want
    assert {r.c for r in got if r.cls} == want


def test_parse_is_a_map(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = parse_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_segments_are_cut_at_the_break_and_keep_it(spark):
    from lawspark.operators.parse import _cut

    df = spark.createDataFrame([(0, "\nAx\nXy\nAz"), (1, "\nCq\nTr"), (2, ""), (3, "\nK1\nI2\nXA\nKA")], "i int, s string")
    got = {r.i: (r.a, r.k) for r in df.select("i", _cut(F.col("s"), "A").alias("a"), _cut(F.col("s"), "KI").alias("k")).collect()}
    assert got[0] == (["", "\nAx\nXy", "\nAz"], ["\nAx\nXy\nAz"])
    assert got[1] == (["\nCq\nTr"], ["\nCq\nTr"])
    assert got[2] == ([""], [""])
    assert got[3] == (["\nK1\nI2\nXA\nKA"], ["", "\nK1", "\nI2\nXA", "\nKA"])


def test_marks_that_only_case_folding_or_unicode_digits_find(parse):
    t = parse("Chương I\nx\nĐiều 1. q\n1. one\nK) kelvin\nſ) long s\n٣. three\nm) x")
    assert outline(t) == [(1, "x", [(1, None, [
        (1, "one", [("K", "kelvin"), ("ſ", "long s")]), (None, "three", [("m", "x")])
    ])])]
