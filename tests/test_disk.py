"""What steps leave on disk: shuffles end with what is written, scratch tables with their batch."""

import hashlib
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lawspark.operators import citation, postings, retrieve, vector_index
from lawspark.session import scratch_dir, settings, temporary, written
from lawspark.sources import collection
from lawspark.streaming import ingest

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_drops_its_shuffles(spark):
    before, setting = _shuffles(spark), spark.conf.get(KEY)
    rows = written(spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).count(), "counts")
    assert _shuffles(spark) <= before
    assert spark.conf.get(KEY) == setting
    assert rows.count() == 7_000


def test_settings_are_restored(spark):
    spark.conf.unset("lawspark.tried")
    with pytest.raises(ValueError), settings(spark, {"lawspark.tried": "1"}):
        assert spark.conf.get("lawspark.tried") == "1"
        raise ValueError
    assert spark.conf.get("lawspark.tried", None) is None


def test_temporary_tables_go(spark):
    with temporary(spark) as keep:
        rows = keep(spark.range(5), "brief")
        path = rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert rows.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_ingest_leaves_no_scratch_tables(spark):
    name = "disk_" + scratch_dir(spark, "c").rsplit("-", 1)[1]
    collection.ensure_collection(spark, name, dim=1)
    ledger = ingest.Ledger.below(scratch_dir(spark, "ledger"))
    root = spark.conf.get("spark.checkpoint.dir")

    def scratch():
        return {d for d in os.listdir(root) if d.rsplit("-", 1)[0] in ("changed", "keyed", "points", "last")} if os.path.isdir(root) else set()

    before = scratch()
    text = "NGHỊ ĐỊNH a\nCăn cứ b\nChương I\nMột\nĐiều 1. Hai\n1. Ba bốn\na) năm\n"
    for n, docs in enumerate(([("x", text), ("y", text)], [("x", text), ("x", text), ("y", None)])):
        ingest.take_changes(spark.createDataFrame(docs, "doc_id string, text string"), name, ledger, lambda: lambda t: [[1.0] for _ in t], collection.batch_number(n))
    assert {r.doc_id for r in collection.current(spark, name).collect()} == {"x"}
    assert scratch() == before
    collection.drop_collection(spark, name)


def test_listed_keys_of_unasked_forms_are_dropped(spark, monkeypatch):
    keys = spark.createDataFrame([(1, None, "a"), (2, 5, None)], "article bigint, clause bigint, point string")
    forms = [(c, p) for c in (5, None) for p in ("a", "b", None)]
    listed = spark.createDataFrame([(f,) for f in forms], "v struct<clause:bigint,point:string>")
    left = {tuple(r.v) for r in listed.where(citation._asked_forms(keys)).collect()}
    assert left == {(None, "a"), (5, None)}
    assert listed.where(citation._asked_forms(keys.where("false"))).isEmpty()
    monkeypatch.setattr(citation, "FORMS", 1)
    assert listed.where(citation._asked_forms(keys)).count() == 6


def _points(spark, ids):
    rows = [(c, f"word{i % 3} and more of {i}", [float(1 + i % 2), 1.0]) for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "chunk_id string, text string, dense array<float>")


def test_numbers_stand_for_ids(spark):
    """Digests are indexed by numbers of their order; other ids, and digests that share a number, as they are."""
    def open_model():
        return lambda texts: [[1.0, 1.0] for _ in texts]

    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    sharing = [d[:15] + "0" * 49 for d in digests[:1]] + digests
    for ids, kind in ((digests, "bigint"), (sharing, "string"), ([f"p{i}" for i in range(40)], "string")):
        points = _points(spark, ids)
        assert points.select(retrieve._key(points)).dtypes[0][1] == kind
    points = _points(spark, digests)
    stored = retrieve.index_collection(points, scratch_dir(spark, "index"), None)
    assert dict(stored.payload.dtypes)["key"] == dict(stored.vectors.vectors.dtypes)["id"] == "bigint"
    question = spark.createDataFrame([(2, "nothing there")], "query_id bigint, text string")
    got = retrieve.retrieve(stored, question, open_model).orderBy("rank").collect()
    assert [r.id for r in got] == sorted(c for i, c in enumerate(digests) if i % 2 == 0)[:7]  # all tie: by id


def test_blocks_hold_numbers_of_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([("x" * 64, ["a", "b"], [1.0, 2.0]), ("y" * 64, ["a"], [3.0])], "id string, indices array<string>, values array<double>")
    stored = postings.build(vectors, str(tmp_path / "postings"))
    numbers = {r.number: r.id for r in stored.vectors.collect()}
    held = sorted((r.term, numbers[n], w) for r in stored.blocks.collect() for n, w in zip(r.ids, r.weights, strict=True))
    assert held == [("a", "x" * 64, 1.0), ("a", "y" * 64, 3.0), ("b", "x" * 64, 2.0)]


@pytest.mark.parametrize("distance", ["cosine", "euclid"])
def test_rows_below_the_limit_stay_in_the_task(distance):
    items = pa.table({"id": [1, 2, 3], "v": [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0]]})
    score = 0.8 if distance == "cosine" else -0.632456
    tau = (2 - 2 * 0.8) ** 0.5 + 2e-6
    queries = pa.table({"query_id": [7, 8], "q": [[1.0, 0.0]] * 2, "tau": pa.array([tau, None], pa.float64())})
    found = vector_index._compared(3, distance, 6, None)(items, queries).to_pylist()
    assert [r["id"] for r in found if r["query_id"] == 7] == [1, 2]
    assert [r["id"] for r in found if r["query_id"] == 8] == [1, 2, 3]
    assert found[1]["score"] == pytest.approx(score, abs=1e-6)
