"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``size`` words (the whole item if shorter).
A window occurs in a text only if all its words do, so one necessary word is
enough to find it: words are ordered by rarity over all documents, and each
window is joined on its rarest word alone. The word's place in the window
fixes where the window would have to begin; that place must lie inside the
text (positional and length bound), and the words there must equal the
window's. Only column expressions, joins and aggregations are used.

Words of all documents are written once; counting and joining read them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawspark.session import written

SIZE = 13
BLOCK_BYTES = 8 << 20  # windows joined in one pass over the words
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    # Lower-casing differs from the wanted A-Z only where non-ASCII letters occur.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(low, _GAPS), "")


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``item_id, window`` (array of words), each once."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    starts = F.explode(F.sequence(F.lit(0), last)).alias("at")
    return w.select("item_id", "w", starts).select(
        "item_id", F.slice("w", F.col("at") + 1, F.lit(size)).alias("window")
    ).distinct()


def contaminated_words(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``row, doc_id, n_words, n_hit, n_items, items`` per row of ``docs(doc_id, text)``.

    ``items`` holds the ids of occurring items, sorted as strings. Ids may be
    null or repeated: rows are told apart by ``row``. Items without words and
    a null item id as such never occur.
    """
    docs = docs.select("doc_id", words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("row"))
    docs = written(docs.withColumn("n_words", F.size("w").cast("long")), "words")
    windows = written(item_windows(benchmark.where("item_id is not null"), size), "windows")

    # Rarity: how often each word of the benchmark occurs in the documents.
    asked = windows.select(F.explode("window").alias("word")).distinct()
    used = docs.select(F.explode("w").alias("word")).join(asked, "word", "left_semi")
    frequency = used.groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("item_id", "window", F.posexplode("window").alias("shift", "word"))
    rarity = placed.join(frequency, "word")
    # A window with a word that no document has cannot occur.
    first = Window.partitionBy("item_id", "window").orderBy("n", "word", "shift")
    keyed = rarity.withColumn("k", F.row_number().over(first)).withColumn(
        "known", F.count("*").over(Window.partitionBy("item_id", "window"))
    ).where((F.col("k") == 1) & (F.col("known") == F.size("window")))
    keyed = written(
        keyed.select("word", "shift", "window", F.size("window").alias("len"), "item_id"), "keyed windows"
    )
    total = keyed.agg(F.sum(F.length(F.to_json(F.struct("window"))) + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))

    # The windows of a block are at most about BLOCK_BYTES, so they are broadcast.
    found = None
    for i in range(blocks):
        part = keyed if blocks == 1 else keyed.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
        at = docs.select("row", "n_words", "w", F.posexplode("w").alias("pos", "word"))
        hits = (
            at.join(F.broadcast(part), "word")
            .withColumn("start", F.col("pos") - F.col("shift"))
            .where("start >= 0 and start + len <= n_words")
            .where(F.slice("w", F.col("start") + 1, F.col("len")) == F.col("window"))
            .select("row", "start", "len", "item_id")
        )
        found = hits if found is None else found.unionByName(hits)
    # Per row: its items, and its hit words as the union of intervals.
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    items = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    per_row = found.groupBy("row").agg(spans.alias("s"), items.alias("items"))
    union = F.expr(
        "aggregate(s, struct(0L as n, 0 as done), (a, x) -> struct("
        "a.n + greatest(x.end - greatest(x.start, a.done), 0) as n, greatest(a.done, x.end) as done), a -> a.n)"
    )
    per_row = per_row.select("row", union.alias("n_hit"), "items")
    out = docs.select("row", "doc_id", "n_words").join(per_row, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
    )


def is_contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, with their columns, that are not contaminated.

    Rows are judged by their text, told by two 64-bit hashes: equal texts share
    one verdict, so repeated rows and null ids need no key.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    judged = contaminated_words(docs.select(key.alias("doc_id"), "text"), benchmark, size)
    bad = judged.where(is_contaminated()).select("doc_id.*").distinct()
    bad = written(bad, "contaminated")
    own = docs.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)})
    same = (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b"))
    return own.join(bad, same, "left_anti").drop("__a", "__b")
