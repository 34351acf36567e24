"""Statutes and look-up requests derived from the given tables, by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawspark.functions.text import strip
from lawspark.operators.chunk import chunk_flat
from lawspark.schemas import REFERENCES
from lawspark.session import spread

DECREE = "Nghị định này"

# Units of text per part of a derived statute.
PER_ARTICLE = 6
PER_SECTION = 18
PER_CHAPTER = 36


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _roman(n: Column) -> Column:
    def digits(one: str, five: str, ten: str) -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2,
                 five + one * 3, one + ten]
        return F.array(*[F.lit(f) for f in forms])

    def place(letters: Column, unit: int) -> Column:
        return F.get(letters, (F.floor(n / unit) % 10).cast("int"))

    return F.concat(
        F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")),
        place(digits("C", "D", "M"), 100), place(digits("X", "L", "C"), 10),
        place(digits("I", "V", "X"), 1),
    )


def statute_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of ``documents`` written as a statute: ``(doc_id, text)``."""
    return statutes_of(spread(table(spark, sf_dir, "documents"), "doc_id"))


def statutes_of(docs: DataFrame, hard: bool = False) -> DataFrame:
    """Rows ``(doc_id, lang, source, text)`` written as statutes: ``(doc_id, text)``.

    The text is cut into units at line and sentence ends. Of every six units
    one is an article's heading, one a clause with the next three as its two
    points, one a clause of its own; every 18 open a section, every 36 a chapter.

    In the ``hard`` form a section's heading stands in the middle of a point,
    between its line and the next, and the first clause of every second
    document has no number.
    """
    units = docs.select(
        "doc_id", "lang", "source",
        F.array_remove(F.transform(F.split("text", "[.\n]+"), strip), "").alias("units"),
    )

    def render(u: Column, i: Column) -> Column:
        def nth(size: int) -> Column:
            return F.floor(i / size) + 1

        role = i % PER_ARTICLE
        chapter = F.when(
            i % PER_CHAPTER == 0,
            F.concat(
                F.lit("Chương "), _roman(nth(PER_CHAPTER)),
                F.lit("\nPhần "), nth(PER_CHAPTER).cast("string"), F.lit("\n"),
            ),
        ).otherwise("")
        number = nth(PER_SECTION).cast("string")
        section = F.when(
            i % PER_SECTION == (3 if hard else 0), F.concat(F.lit("Mục "), number, F.lit(". Nhóm "), number, F.lit("\n"))
        ).otherwise("")
        first = F.when(F.col("doc_id") % 2 == 0, "Nội dung ").otherwise("1. ") if hard else F.lit("1. ")
        mark = (
            F.when(role == 0, F.concat(F.lit("Điều "), nth(PER_ARTICLE).cast("string"), F.lit(". ")))
            .when(role == 1, first).when(role == 2, "a) ").when(role == 3, "- ")
            .when(role == 4, "đ) ").otherwise("2. ")
        )
        return F.concat(chapter, section, mark, u)

    return units.select(
        "doc_id",
        F.concat(
            F.lit("NGHỊ ĐỊNH "), "source", F.lit("\nCăn cứ "), "lang", F.lit("\n"),
            F.array_join(F.transform("units", render), "\n"),
        ).alias("text"),
    )


def _reference(article: Column, point: Column | None = None) -> Column:
    return F.array(F.struct(
        F.lit(DECREE).alias("document"), article.cast("bigint").alias("article"),
        F.lit(None).cast("bigint").alias("clause"),
        (point if point is not None else F.lit(None).cast("string")).alias("point"),
    )).cast(REFERENCES)


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a code kept in tables: region, nation, customer, order, line.

    Region is the document, nation the chapter, customer the article, order
    the clause, line the point. Lines returned refer to the article of their
    supplier, pending orders to points ``a`` of the article of their nation.
    """
    t = lambda name: table(spark, sf_dir, name)
    clauses = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "o_orderkey",
            F.col("r_regionkey").cast("bigint").alias("doc_id"),
            F.concat(F.lit("NGHỊ ĐỊNH "), "r_name").alias("document_title"),
            F.col("n_nationkey").alias("chapter_pos"),
            (F.col("n_nationkey") + 1).cast("bigint").alias("chapter_number"),
            F.col("n_name").alias("chapter_title"),
            F.col("c_custkey").alias("article_pos"),
            (F.col("c_custkey") + 1).alias("article_number"),
            F.concat(F.lit("Điều "), (F.col("c_custkey") + 1).cast("string"), F.lit(". "), "c_name")
            .alias("article_title"),
            F.col("c_mktsegment").alias("category"),
            F.col("o_orderkey").alias("clause_pos"),
            F.col("o_orderkey").alias("clause_number"),
            F.col("o_orderpriority").alias("content"),
            F.when(
                F.col("o_orderstatus") == "P", _reference(F.col("c_nationkey") + 1, F.lit("a"))
            ).alias("references"),
        )
    )
    lines = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("returned")
    )
    points = (
        # Dealt by order once, for the lines and for the join with the orders.
        lines.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"),
            F.bool_or("returned").alias("returned"),
        )
        .select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.col("l_linenumber").alias("point_pos"),
            F.chr(F.col("l_linenumber") + 96).alias("point"),
            F.concat(F.lit("part "), F.col("part").cast("string")).alias("content"),
            F.when(F.col("returned"), _reference(F.col("supp") + 1)).alias("references"),
        )
    )
    return chunk_flat(clauses, points, ["o_orderkey"])


def direct_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order; its priority says what the request leaves open."""
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("req_id"),
        F.when(p != "5-LOW", F.col("o_custkey") + 1).otherwise(0).alias("article"),
        F.when(p.isin("2-HIGH", "4-NOT SPECIFIED"), F.col("o_orderkey")).alias("clause"),
        F.when(p == "3-MEDIUM", "a").when(p == "4-NOT SPECIFIED", "b").alias("point"),
    )


def supplier_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier for the article of its number.

    Suppliers in debt ask for points ``a`` only.
    """
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("req_id"),
        F.lit(DECREE).alias("document"),
        (F.col("s_suppkey") + 1).alias("article"),
        F.lit(None).cast("bigint").alias("clause"),
        F.when(F.col("s_acctbal") < 0, "a").alias("point"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model response per supplier; its region says what the response calls.

    Among the calls are some that are no strict JSON (single quotes, a brace
    too many, an open end) and one whose arguments are a text.
    """
    s = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    art = (F.col("s_suppkey") + 1).cast("string")

    def call(*body: str | Column) -> Column:
        parts = [F.lit(b) if isinstance(b, str) else b for b in body]
        return F.concat(F.lit("<tool_call>"), *parts, F.lit("</tool_call>"))

    direct = call('{"name": "extract_clause_point", "arguments": {"article": ', art, "}}")
    inbound = call(
        '\n{"name": "extract_relevant_clause_point", "arguments": {"document": "', DECREE,
        '", "article": ', art, ', "clause": null}}\n',
    )
    outbound = call(
        '{"name": "extract_clause_point_references", "arguments": {"article": ', art, ', "point": "a"}}'
    )
    unknown = call('{"name": "search_law", "arguments": {"q": "', F.col("s_name"), '"}}')
    broken = call('{"name": "extract_clause_point", "arguments": {"article": ')
    missing = call('{"name": "extract_clause_point"}')
    quotes = call("{'name': 'extract_clause_point', 'arguments': {'article': 1}}")
    brace = call('{"name": "extract_clause_point", "arguments": {"article": ', art, "}}}")
    text = call('{"name": "extract_clause_point", "arguments": "{\\"article\\": ', art, '}"}')
    r = F.col("n_regionkey")
    return s.select(
        F.col("s_suppkey").alias("resp_id"),
        F.when(r == 0, F.concat(F.lit("Tra cứu. "), quotes, brace, direct))
        .when(r == 1, inbound)
        .when(r == 2, F.concat(broken, outbound))
        .when(r == 3, F.concat(unknown, F.lit("\n"), direct, F.lit("<tool_call>{")))
        .otherwise(F.concat(missing, F.lit(" không cần"), text))
        .alias("response"),
    )
