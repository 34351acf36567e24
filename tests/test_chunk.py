import json

import pytest
from pyspark.sql import functions as F

from lawspark.operators.chunk import chunk_documents, chunk_flat
from lawspark.operators.parse import parse_documents
from lawspark.schemas import TREE
from lawspark.sources.corpus import read_documents, read_texts, write_documents

DOC = {
    "document_title": "T", "legal_basis": "B",
    "chapters": [
        {"chapter_number": 1, "chapter_title": "C1", "articles": []},
        {"chapter_number": 2, "articles": [{
            "article_number": 7, "article_title": "A7",
            "clauses": [
                {"clause_number": 1, "content": " bare ", "references": [{"document": "d", "article": 3}]},
                {"clause_number": 2, "content": "  "},
                {"clause_number": 3, "content": "intro", "references": [{"document": "d", "article": 4}],
                 "points": [
                     {"point": "a", "content": " pa "},
                     {"point": "b", "content": "pb", "references": [{"document": "d", "article": 5}]},
                     {"point": "c", "content": " "},
                 ]},
                {"clause_number": 4, "content": "", "points": [{"point": "a", "content": "x"}]},
            ],
        }]},
        {"chapter_number": 3, "chapter_title": "C3"},
    ],
}


@pytest.fixture(scope="module")
def rows(spark):
    raw = spark.createDataFrame([("d1", json.dumps(DOC))], "doc_id string, j string")
    tree = raw.select("doc_id", F.from_json("j", TREE).alias("d")).select("doc_id", "d.*")
    return chunk_documents(tree).orderBy("chunk_pos").collect()


def test_texts_in_document_order(rows):
    assert [r.text for r in rows] == [
        "A7\nbare",
        "A7\nKhung hình phạt/Quy định: intro\nChi tiết (a): pa",
        "A7\nKhung hình phạt/Quy định: intro\nChi tiết (b): pb",
        "A7\nChi tiết (a): x",
        "Căn cứ pháp lý của văn bản:\nB",
    ]


def test_kinds_labels_and_lineage(rows):
    assert [(r.point, r.is_point) for r in rows] == [
        ("-1", False), ("a", True), ("b", True), ("a", True), (None, None)
    ]
    first = rows[0]
    assert (first.document_title, first.chapter_number, first.chapter_title) == ("T", 2, "No Title")
    assert (first.article_number, first.article_category, first.clause_number) == (7, "", 1)


def test_references_own_else_of_the_clause(rows):
    assert [[x.article for x in r.references] for r in rows] == [[3], [4], [5], [], []]


def test_legal_basis_counts_all_chapters(rows):
    last = rows[-1]
    assert (last.type, last.chapter_total, last.article_total, last.article_number) == (
        "legal_basis", 3, 1, None
    )


def test_ids_are_stable_and_distinct(rows):
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_defaults_and_no_basis(spark):
    raw = spark.createDataFrame([("d", '{"chapters":[{"articles":[{"clauses":[{"content":"q"}]}]}]}'),
                                 ("e", "{}")], "doc_id string, j string")
    tree = raw.select("doc_id", F.from_json("j", TREE).alias("d")).select("doc_id", "d.*")
    (r,) = chunk_documents(tree).collect()
    assert (r.text, r.document_title, r.chapter_title, r.references) == (
        "\nq", "Untitled Document", "No Title", []
    )


def test_flat_form_gives_the_same_chunks(spark, rows):
    c = DOC["chapters"][1]["articles"][0]
    ref = "array<struct<document:string,article:bigint,clause:bigint,point:string>>"
    as_refs = lambda xs: [(x["document"], x["article"], None, None) for x in xs or []]
    clauses = spark.createDataFrame(
        [("d1", "T", 1, 2, "No Title", 0, 7, "A7", "", i, k["clause_number"], k["content"],
          as_refs(k.get("references"))) for i, k in enumerate(c["clauses"])],
        "doc_id string, document_title string, chapter_pos int, chapter_number bigint, "
        "chapter_title string, article_pos int, article_number bigint, article_title string, "
        f"category string, clause_pos int, clause_number bigint, content string, references {ref}",
    )
    points = spark.createDataFrame(
        [(i, j, p["point"], p["content"], as_refs(p.get("references")))
         for i, k in enumerate(c["clauses"]) for j, p in enumerate(k.get("points", []))],
        f"clause_pos int, point_pos int, point string, content string, references {ref}",
    )
    flat = chunk_flat(clauses, points, ["clause_pos"]).orderBy("chunk_pos").collect()
    assert [tuple(r) for r in flat] == [tuple(r) for r in rows if r.chunk_kind != "legal_basis"]


def test_json_round_trip_and_quarantine(spark, tmp_path):
    text = "NGHỊ ĐỊNH Q\nChương I\nx\nMục 1. S\nĐiều 1. a\n1. one\na) p\n2. two\nĐiều 2. b"
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "one.txt").write_text(text, encoding="utf-8")
    tree = parse_documents(read_texts(spark, str(raw)))
    write_documents(tree.drop("doc_id"), str(tmp_path / "out"))
    (line,) = [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text("utf-8").splitlines()]
    clauses = json.loads(line)["chapters"][0]["articles"][0]["clauses"]
    assert "points" in clauses[0] and "points" not in clauses[1]
    assert "category" in json.loads(line)["chapters"][0]["articles"][0]

    files = tmp_path / "in"
    files.mkdir()
    (files / "good.json").write_text(line, encoding="utf-8")
    (files / "list.json").write_text("[" + line + "]", encoding="utf-8")
    (files / "cut.json").write_text(line[:-5], encoding="utf-8")
    (files / "tail.json").write_text(line + " x", encoding="utf-8")
    docs, bad = read_documents(spark, str(files))
    drop = lambda df: [tuple(r) for r in chunk_documents(df).select("text", "point").collect()]
    assert drop(docs) == drop(tree) and docs.count() == 1
    assert bad.count() == 3
    docs, bad = read_documents(spark, str(tmp_path / "missing"))
    assert docs.count() == 0 and bad.count() == 0
