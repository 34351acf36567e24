"""Near-duplicates without ids, and versions under one id: one of each group stays."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_one_of_each_group_whatever_the_ids(spark):
    def words(name, n=80):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [
        (None, words("a")), (None, words("a") + " more"), (None, words("a") + " other"),  # no ids at all
        (3, words("b")), (3, words("b") + " more"), (4, words("b") + " other"),  # two versions under the smallest id
        (None, words("c")), (7, words("c") + " more"), (6, words("c") + " other"),  # an id beats none
        (8, words("d")), (8, words("d")), (9, words("d")),  # the same row twice
        (None, ""), (None, ""), (None, None), (10, ""), (11, ""),  # texts without words
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in P.near_dedup(spark, docs, SF).collect()]
    of = lambda letter: [x for x in got if (x[1] or "").startswith(letter)]
    assert [len(of(x)) for x in "abcd"] == [1, 1, 1, 1], got
    assert of("a")[0][0] is None and of("b")[0][0] == 3 and of("c")[0][0] == 6 and of("d")[0][0] == 8
    assert {10, 11} <= {d for d, t in got if t == ""}


def test_rows_without_ids_do_not_multiply(spark, monkeypatch):
    """Each candidate text is read once for its set, also where no row, or every row, has the same id."""
    from lawspark.llm import minhash

    seen = spark.sparkContext.accumulator(0)
    plain = minhash._sets

    def counting(k):
        run = plain(k)

        def counted(batches):
            def each():
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return run(each())

        return counted

    monkeypatch.setattr(minhash, "_sets", counting)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(400)]
    rows = [(None, t) for t in texts] + [(None, t + " more") for t in texts] + [(7, t + " others") for t in texts]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.groupBy("component").count().where("count = 3").count() == len(texts)
    assert len(rows) * 0.9 <= seen.value <= len(rows)


def test_columns_named_as_ours_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "own"), (2, "a b c d e f", "own")], "doc_id long, text string, __text string")
    assert [tuple(r) for r in P.near_dedup(spark, docs, SF).collect()] == [(1, "a b c d e f", "own")]
