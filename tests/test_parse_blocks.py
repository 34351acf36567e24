"""Blocks of lines against the parser of whole texts, on random statutes."""

import random

import pytest
from pyspark.sql import functions as F

from lawspark.operators import parse, parse_blocks

KINDS = [
    lambda r: f"Chương {r.choice(['I', 'II', 'IV', 'X'])}", lambda r: f"Mục {r.randint(1, 3)}. Nhóm", lambda r: f"Điều {r.randint(1, 9)}. Tên",
    lambda r: f"{r.randint(1, 5)}. khoản", lambda r: f"{r.choice('abđ')}) điểm", lambda r: "lời văn", lambda r: "  ", lambda r: "- tiếp theo",
]
WEIGHTS = [2, 1, 3, 4, 4, 4, 1, 2]


def _texts():
    r = random.Random(11)
    out = []
    for n in range(120):
        weights = WEIGHTS if n % 3 else [9, 1, 2, 1, 1, 1, 0, 0]  # runs of chapter lines
        body = "\n".join(r.choices(KINDS, weights)[0](r) for _ in range(r.randint(0, 40)))
        head = r.choice(["", "NGHỊ ĐỊNH\nCăn cứ luật\n", "NGHỊ ĐỊNH\nĐiều 1. Trước chương\n1. bị bỏ\nChương I\n", "Theo Chương I của luật\n"])
        out.append((n, head + body))
    return [*out, (900, None), (901, ""), (902, "Chương I"), (903, "\n\n"), (904, "Chương I\n" * 9 + "Điều 1. A\n1. b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_texts(), "doc_id bigint, text string").repartition(4)


def _rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("size", [1, 5])
def test_equals_whole_texts(docs, size):
    tree = parse.parse_documents(docs)
    got = parse_blocks.parse_blocks(parse_blocks.cut(docs, size))
    long = lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]
    a = ["doc_id", *long("chapter_pos", "article_pos"), "chapter_number", "chapter_title", "article_number", "article_title", "category"]
    assert _rows(got.articles, a) == _rows(parse.explode_articles(tree), a)
    c = ["doc_id", *long("chapter_pos", "article_pos", "clause_pos"), "article_number", "clause_number", "content"]
    assert _rows(got.clauses, c) == _rows(parse.explode_clauses(tree), c)
    p = ["doc_id", *long("chapter_pos", "article_pos", "clause_pos", "point_pos"), "article_number", "clause_number", "point", "content"]
    assert _rows(got.points, p) == _rows(parse.explode_points(tree), p)


def test_lines_are_found_once_and_carried_in_three_passes(spark, docs, monkeypatch):
    """Blocks and lines are written, not cut and classed again by each pass; counts and values share a pass."""
    plans, plain = {}, parse_blocks.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(parse_blocks, "written", noted)
    parse_blocks.parse_blocks(parse_blocks.cut(docs, 5))
    assert list(plans) == ["blocks", "body", "lines"]
    assert plans["lines"].count("Generate ") == 0
    assert plans["lines"].count("Join ") <= 7  # three passes, each adding up what those before it gave; there were 63 joins
