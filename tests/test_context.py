import json

import pytest
from pyspark.sql import functions as F

from lawspark.operators import context, toolcalls

from test_citation import CHUNKS, SCHEMA

ROWS = "k bigint, rank bigint, point string, clause_number bigint, article_number bigint, " \
       "article_title string, chapter_number bigint, document_title string, type string, text string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (1, 2, "-1", 0, 7, "T%s", 3, "D", None, "two"),
        (1, 1, "a", 2, 7, "T7", 3, "D", None, "one"),
        (1, 3, None, None, None, None, None, "D", "legal_basis", "basis"),
        (2, 1, "", 0, 0, "", 0, None, None, "none"),
        (3, 1, None, None, 5, None, None, "D", None, "x"),
    ], ROWS)


@pytest.fixture(scope="module")
def keys(spark):
    return spark.createDataFrame([(1,), (2,), (3,), (4,)], "k bigint")


def test_records(keys, rows):
    got = {r.k: r.formatted for r in context.format_records(keys, rows, "k").collect()}
    assert got[1] == (
        "--- Kết quả 1 (Điểm a, Khoản 2, Điều 7, (T7)) ---\none\n\n"
        "--- Kết quả 2 (Điểm -1, Điều 7, (T%s)) ---\ntwo\n\n--- Kết quả 3 (D) ---\nbasis"
    )
    assert got[2] == "--- Kết quả 1 (Tài liệu) ---\nnone"
    assert got[4] == "Không tìm thấy dữ liệu phù hợp."


def test_context(keys, rows):
    got = {r.k: r.context for r in context.format_context(keys, rows, "k").collect()}
    assert got[1] == (
        "--- Trích dẫn 1 (Điểm a, Khoản 2, Điều 7 (T7), Chương 3) ---\none\n\n"
        "--- Trích dẫn 2 (Điểm -1, Điều 7 (T%s), Chương 3) ---\ntwo\n\n"
        "--- Trích dẫn 3 (Căn cứ pháp lý của: D) ---\nbasis"
    )
    assert got[2] == "--- Trích dẫn 1 (Tài liệu không xác định) ---\nnone"
    assert got[3] == "--- Trích dẫn 1 (Điều 5) ---\nx"
    assert got[4] == ""


def test_prompt_takes_texts_as_they_are(spark):
    got = spark.range(1).select(context.rag_prompt(F.lit("{c} %d"), F.lit("q?"))).first()[0]
    assert got.startswith("Dưới đây là") and got.endswith("\n\n### Trả lời:\n")
    assert "### Ngữ cảnh:\n{c} %d\n\n### Câu hỏi:\nq?\n" in got


def test_messages(spark):
    conv = spark.createDataFrame([("c",)], "conv_id string")
    prompts = spark.createDataFrame([("c", "ask")], "conv_id string, content string")
    history = spark.createDataFrame(
        [("c", 1, "assistant", "a"), ("c", 0, "user", "u")], "conv_id string, turn int, role string, content string"
    )
    m = context.messages(conv, prompts, history, "sys").orderBy("part", "turn").collect()
    assert [(r.role, r.content) for r in m] == [
        ("system", "sys"), ("user", "u"), ("assistant", "a"), ("user", "ask")
    ]


def call(name, args):
    return "<tool_call>" + json.dumps({"name": name, "arguments": args}) + "</tool_call>"


RESPONSES = {
    1: "no call, <tool_call>{\"name\": \"x\"}",
    2: "a " + call("extract_clause_point", {"article": 2}) + " b <tool_call>{bad</tool_call>"
       + call("extract_clause_point_references", {"article": 2, "clause": 1}),
    3: call("nothing", {"a": 1}) + "<tool_call>[1]</tool_call>"
       + "<tool_call>\n{\"name\": \"extract_clause_point\"}\n</tool_call>",
    4: call("extract_relevant_clause_point", {"document": "X", "article": 1, "point": None})
       + call("extract_relevant_clause_point", {"article": 1}),
    5: call("extract_clause_point", {"article": 2, "extra": 1}) + call("extract_clause_point", {"article": None})
       + call("extract_clause_point", {"article": 2, "clause": "1"}),
}


@pytest.fixture(scope="module")
def calls(spark):
    responses = spark.createDataFrame(list(RESPONSES.items()), "resp_id bigint, response string")
    chunks = spark.createDataFrame(CHUNKS, SCHEMA).withColumn("article_title", F.lit("T")).withColumn(
        "document_title", F.lit("D"))
    checked = toolcalls.check_calls(toolcalls.extract_calls(responses))
    return responses, checked, toolcalls.resolve_calls(checked, chunks)


def test_call_log(calls):
    _, checked, results = calls
    got = {
        (r.resp_id, r.call_id): (r["name"], r.status, r.results_count, r.error)
        for r in toolcalls.call_log(checked, results).collect()
    }
    n2 = sum(c[3] == 2 for c in CHUNKS)
    assert got[2, 1] == ("extract_clause_point", "success", min(n2, 50), None)
    assert got[2, 2][:2] == ("extract_clause_point_references", "success") and got[2, 2][2] > 0
    assert got[3, 1] == ("nothing", "error", None, "Hàm không tồn tại")
    assert got[3, 2] == ("extract_clause_point", "error", None, "bad arguments")
    assert got[4, 1][:3] == ("extract_relevant_clause_point", "success", 50)
    assert got[4, 2][1] == "error"
    assert got[5, 1][1] == "error"
    assert got[5, 2] == ("extract_clause_point", "success", 0, None)
    assert got[5, 3] == ("extract_clause_point", "success", 0, None)  # "1" is no number
    assert len(got) == 9


def test_follow_up(calls):
    responses, checked, results = calls
    texts = toolcalls.follow_up(checked, results)
    got = {r.resp_id: r.content for r in texts.collect()}
    assert set(got) == {2, 4, 5}
    assert got[2].startswith("Kết quả từ các công cụ:\n--- Kết quả 1 (")
    assert got[5].count("Không tìm thấy dữ liệu phù hợp.") == 2
    m = toolcalls.follow_up_messages(responses, texts).where("resp_id = 5").orderBy("part").collect()
    assert [r.role for r in m] == ["assistant", "user"] and m[0].content == RESPONSES[5]


def test_answer_records(spark, calls):
    _, checked, results = calls
    log = toolcalls.call_log(checked, results)
    answers = spark.createDataFrame([(1, "không"), (2, "có")], "resp_id bigint, answer string")
    docs = spark.createDataFrame(
        [(2, 2, "b", 0.1, 0.0, 0.0, "tb", "{}"), (2, 1, "a", 0.2, 0.0, 0.0, "ta", '{"point": "đ", "is_point": true}')],
        "resp_id bigint, rank bigint, id string, total_score double, sparse_score double, "
        "dense_score double, text string, metadata string",
    )
    got = {r.resp_id: r.record for r in toolcalls.answer_records(answers, docs, log).collect()}
    assert "không" in got[1]
    assert json.loads(got[1]) == {"docs": [], "answer": "không", "thinking": [], "tool_calls": []}
    two = json.loads(got[2])
    assert [d["id"] for d in two["docs"]] == ["a", "b"] and [c["id"] for c in two["tool_calls"]] == [1, 2]
    assert two["docs"][0]["metadata"] == {"point": "đ", "is_point": True}
    assert two["tool_calls"][0] == {
        "id": 1, "name": "extract_clause_point", "args": {"article": 2}, "status": "success",
        "results_count": min(50, sum(c[3] == 2 for c in CHUNKS)),
    }


def test_calls_that_are_no_strict_json(spark):
    from lawspark.operators import toolcalls

    good = '{"name": "extract_clause_point", "arguments": {"article": 7}}'
    bad = [
        "{'name': 'extract_clause_point', 'arguments': {'article': 1}}", good + "}", good + "]", good + " x",
        good + ", {}", good[:-1], "[1]", "", '"text"', good + ',"y":{}',
    ]
    text = '{"name": "extract_clause_point", "arguments": "{\\"article\\": 7}"}'
    response = "".join(f"<tool_call>{c}</tool_call>" for c in [*bad, f"\n {good}\n", text])
    df = spark.createDataFrame([(1, response)], "resp_id bigint, response string")
    calls = toolcalls.check_calls(toolcalls.extract_calls(df)).orderBy("call_id").collect()
    assert [(c.call_id, c.callable, c.article) for c in calls] == [(1, True, 7), (2, False, None)]
    skipped = toolcalls.skipped_calls(df).collect()
    assert sorted((s.place, s.call) for s in skipped) == list(enumerate(bad, 1))
