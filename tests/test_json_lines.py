"""JSON documents, many in a file."""

from lawspark.operators.parse import parse_documents
from lawspark.plans.corpora import statute_texts
from lawspark.plans.queries import QUERIES
from lawspark.sources.corpus import read_document_lines, write_documents

SF = "/root/testdata/sf0.001"


def test_lines_and_quarantine(spark, tmp_path):
    tree = parse_documents(statute_texts(spark, SF).limit(20))
    path = str(tmp_path / "lines")
    write_documents(tree.coalesce(1), path)
    files = list((tmp_path / "lines").glob("*.json"))
    assert len(files) == 1
    lines = files[0].read_text("utf-8").splitlines()
    with open(tmp_path / "lines" / "more.txt", "w", encoding="utf-8") as f:
        f.write(lines[0] + "}\n[" + lines[1] + "]\n" + lines[2][:-3] + "\n" + lines[3] + " x\n")
    docs, bad = read_document_lines(spark, path)
    ids = {str(r.doc_id) for r in tree.select("doc_id").collect()}
    assert docs.count() == 20 and {r.doc_id for r in docs.select("doc_id").collect()} == ids
    assert bad.count() == 4
    docs, bad = read_document_lines(spark, str(tmp_path / "missing"))
    assert docs.count() == 0 and bad.count() == 0


def test_round_trip_takes_unlabelled_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id")
    got = QUERIES["documents_json_lines_round_trip"](spark, SF)
    assert got.count() == docs.count()
    assert got.join(labels, "doc_id", "left_anti").count() == docs.join(labels, "doc_id", "left_anti").count() > 0
