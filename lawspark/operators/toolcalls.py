"""Tool calls in model responses: find, check, resolve, log, answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawspark.functions.text import is_json_object
from lawspark.operators.citation import lookup_direct, lookup_inbound, lookup_outbound
from lawspark.operators.context import format_records
from lawspark.schemas import LOOKUP_ARGS

# The call mark, the look-ups' names with their parameters, and wording.
CALL_PATTERN = r"(?s)<tool_call>(.*?)</tool_call>"
DIRECT = "extract_clause_point"
INBOUND = "extract_relevant_clause_point"
OUTBOUND = "extract_clause_point_references"
PARAMETERS = {
    DIRECT: ["article", "clause", "point"],
    INBOUND: ["document", "article", "clause", "point"],
    OUTBOUND: ["article", "clause", "point"],
}
REQUIRED = {DIRECT: ["article"], INBOUND: ["document", "article"], OUTBOUND: ["article"]}
UNKNOWN_FUNCTION = "Hàm không tồn tại"
FOLLOW_UP_BEFORE = "Kết quả từ các công cụ:\n"
FOLLOW_UP_AFTER = (
    "\n\nDựa trên thông tin bổ sung này, hãy trả lời câu hỏi của tôi một cách chi tiết và chính xác."
)

# Ours: the reason for a known function called with wrong arguments.
BAD_ARGUMENTS = "bad arguments"


def _any_name(name: Column) -> Column:
    return name.isin(*PARAMETERS)


def extract_calls(responses: DataFrame) -> DataFrame:
    """``(resp_id, call_id, name, args)``: well-formed calls, numbered from 1.

    ``responses(resp_id, response)``. ``args`` is JSON text, ``{}`` if the call
    has none. What is not a JSON object is skipped and gets no number.
    """
    found = F.regexp_extract_all("response", F.lit(CALL_PATTERN), F.lit(1))
    calls = responses.select("resp_id", F.posexplode(F.filter(found, is_json_object)).alias("i", "call"))
    has_args = F.array_contains(F.json_object_keys("call"), "arguments")
    given = F.try_variant_get(F.try_parse_json("call"), "$.arguments", "variant")
    is_object = F.schema_of_variant(given).startswith("OBJECT")
    # A text that holds JSON is a text: it keeps its quotes.
    args = F.when(is_object, F.get_json_object("call", "$.arguments")).otherwise(F.to_json(given))
    return calls.select(
        "resp_id",
        (F.col("i") + 1).cast("bigint").alias("call_id"),
        F.get_json_object("call", "$.name").alias("name"),
        F.when(has_args, F.coalesce(args, F.lit("null"))).otherwise("{}").alias("args"),
    )


def skipped_calls(responses: DataFrame) -> DataFrame:
    """``(resp_id, place, call)``: marked calls that are no JSON object; places count all marks from 1."""
    found = F.regexp_extract_all("response", F.lit(CALL_PATTERN), F.lit(1))
    marks = responses.select("resp_id", F.posexplode(found).alias("i", "call"))
    return marks.where(~is_json_object(F.col("call"))).select(
        "resp_id", (F.col("i") + 1).cast("bigint").alias("place"), "call"
    )


def check_calls(calls: DataFrame) -> DataFrame:
    """Add ``known``, ``callable`` and the typed argument columns.

    A call is callable if its arguments are an object with all required names
    and no undeclared ones. A value of another type than declared matches no
    chunk; such a call is asked with no article and finds nothing.
    """
    keys = F.json_object_keys("args")

    def per_function(names: dict[str, list[str]]) -> Column:
        out = F.array().cast("array<string>")
        for fn, params in names.items():
            out = F.when(F.col("name") == fn, F.array(*[F.lit(p) for p in params])).otherwise(out)
        return out

    declared, required = per_function(PARAMETERS), per_function(REQUIRED)
    known = F.coalesce(_any_name(F.col("name")), F.lit(False))
    fits = (
        is_json_object(F.col("args"))
        & (F.size(F.array_except(keys, declared)) == 0)
        & (F.size(F.array_except(required, keys)) == 0)
    )
    typed = calls.select(
        "*", known.alias("known"), F.coalesce(known & fits, F.lit(False)).alias("callable"),
        F.from_json("args", LOOKUP_ARGS).alias("a"),
    )
    mistyped = F.lit(False)
    for p in ("clause", "point", "article", "document"):
        given = F.get_json_object("args", f"$.{p}").isNotNull()
        mistyped = mistyped | (given & F.col(f"a.{p}").isNull())
    return typed.select(
        *calls.columns, "known", "callable",
        F.col("a.document").alias("document"),
        F.when(~mistyped, F.col("a.article")).alias("article"),
        F.col("a.clause").alias("clause"),
        F.col("a.point").alias("point"),
    )


def resolve_calls(checked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Look-up results of all callable calls: ``(resp_id, call_id, rank, …)``."""
    requests = checked.where("callable").select(
        F.struct("resp_id", "call_id").alias("req_id"), "name", "document", "article", "clause", "point"
    )

    def of(name: str) -> DataFrame:
        return requests.where(F.col("name") == name).drop("name")

    found = (
        lookup_direct(of(DIRECT), chunks)
        .unionByName(lookup_inbound(of(INBOUND), chunks))
        .unionByName(lookup_outbound(of(OUTBOUND), chunks))
    )
    return found.select("req_id.*", *[c for c in found.columns if c != "req_id"])


def call_log(checked: DataFrame, results: DataFrame) -> DataFrame:
    """``(resp_id, call_id, name, args, status, results_count, error)``."""
    counts = results.groupBy("resp_id", "call_id").agg(F.count("*").alias("n"))
    ok = F.col("callable")
    return checked.join(counts, ["resp_id", "call_id"], "left").select(
        "resp_id", "call_id", "name", "args",
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(ok, F.coalesce("n", F.lit(0).cast("bigint"))).alias("results_count"),
        F.when(~F.col("known"), UNKNOWN_FUNCTION).when(~ok, BAD_ARGUMENTS).alias("error"),
    )


def follow_up(checked: DataFrame, results: DataFrame) -> DataFrame:
    """Message with the results of the calls, per response: ``(resp_id, content)``.

    No row for a response without a successful call. What is joined is bounded
    by the calls written in one response and by the row caps.
    """
    asked = checked.where("callable").select(F.struct("resp_id", "call_id").alias("req_id"))
    records = results.withColumn("req_id", F.struct("resp_id", "call_id")).drop("resp_id", "call_id")
    texts = format_records(asked, records).select("req_id.*", "formatted")
    ordered = F.array_sort(F.collect_list(F.struct("call_id", "formatted")))
    return texts.groupBy("resp_id").agg(ordered.alias("t")).select(
        "resp_id",
        F.concat(
            F.lit(FOLLOW_UP_BEFORE), F.array_join(F.col("t.formatted"), "\n\n"), F.lit(FOLLOW_UP_AFTER)
        ).alias("content"),
    )


def follow_up_messages(responses: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """The two messages that go on after a tool call: assistant, then user.

    ``(resp_id, part, turn, role, content)``, continuing the message table of
    ``context.messages`` after its part 2.
    """
    both = responses.join(follow_ups, "resp_id")
    turn = F.explode(F.array(
        F.struct(F.lit(3).alias("part"), F.lit("assistant").alias("role"), F.col("response").alias("content")),
        F.struct(F.lit(4).alias("part"), F.lit("user").alias("role"), F.col("content").alias("content")),
    ))
    return both.select("resp_id", turn.alias("m")).select(
        "resp_id", "m.part", F.lit(0).cast("bigint").alias("turn"), "m.role", "m.content"
    )


def answer_records(
    answers: DataFrame, docs: DataFrame, log: DataFrame, thinking: DataFrame | None = None
) -> DataFrame:
    """One JSON record per response: ``{docs, answer, thinking, tool_calls}``.

    ``answers(resp_id, answer)``; ``docs(resp_id, rank, id, total_score,
    sparse_score, dense_score, text, metadata)``, the metadata as JSON text;
    ``thinking(resp_id, thinking array<string>)``. The lists are bounded by
    top-k and by the response.
    """
    doc = F.struct("id", "total_score", "sparse_score", "dense_score", "text", "metadata")
    call = F.struct(F.col("call_id").alias("id"), "name", "args", "status", "results_count", "error")

    def gathered(rows: DataFrame, order: str, item: Column, json_field: str, out: str) -> DataFrame:
        """Items of one response in order; their JSON text becomes part of the record."""
        pairs = F.array_sort(F.collect_list(F.struct(order, item.alias("item"))))
        items = F.transform(
            F.col("p.item"),
            lambda x: x.withField(json_field, F.try_parse_json(x[json_field])),
        )
        return rows.groupBy("resp_id").agg(pairs.alias("p")).select("resp_id", items.alias(out))

    per_doc = gathered(docs, "rank", doc, "metadata", "docs")
    per_call = gathered(log, "call_id", call, "args", "tool_calls")
    out = answers.join(per_doc, "resp_id", "left").join(per_call, "resp_id", "left")
    if thinking is not None:
        out = out.join(thinking, "resp_id", "left")
    else:
        out = out.withColumn("thinking", F.array().cast("array<string>"))

    def or_empty(df: DataFrame, name: str) -> Column:
        return F.coalesce(name, F.array().cast(df.schema[name].dataType)).alias(name)

    steps = F.coalesce("thinking", F.array().cast("array<string>"))
    # The answer is written as an array of one, whose brackets go.
    one = F.expr("substring(to_json(array(answer)), 2, length(to_json(array(answer))) - 2)")
    # Partial scores may be missing, but their keys stay; a call has no count or no error.
    parts = [
        '{"docs":', F.to_json(or_empty(per_doc, "docs"), {"ignoreNullFields": "false"}),
        ',"answer":', one,
        ',"thinking":', F.to_json(steps), ',"tool_calls":', F.to_json(or_empty(per_call, "tool_calls")), "}",
    ]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return out.select("resp_id", text.alias("record"))
