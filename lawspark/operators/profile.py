"""Length profile of passages: summary, histogram, smoothed density.

Each report starts from the table of distinct lengths and their counts. Its
size is bounded by the longest text, not by the number of texts, and it is
combined on the map side, so one length held by most texts is no hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawspark.functions.text import word_count

# Fixed value: number of histogram bins.
BINS = 30


def lengths(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_chars`` (code points) and ``n_words`` to each chunk."""
    text = F.col(text_col)
    return chunks.withColumns({
        "n_chars": F.char_length(text).cast("bigint"), "n_words": word_count(text).cast("bigint")
    })


def length_counts(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """``(measure, len, n)`` for characters and words, one pass over the texts."""
    both = lengths(chunks, text_col).select(
        F.explode(F.array(
            F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("len")),
            F.struct(F.lit("words").alias("measure"), F.col("n_words").alias("len")),
        )).alias("m")
    )
    return both.groupBy("m.measure", "m.len").agg(F.count("*").alias("n"))


def length_summary(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Count, mean, max, min and exact median of the character length.

    One row; none for empty input.
    """
    by_len = (
        chunks.select(F.char_length(text_col).cast("bigint").alias("len"))
        .groupBy("len").agg(F.count("*").alias("n"))
    )
    return by_len.agg(
        F.sum("n").alias("n_chunks"),
        (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("avg_chars"),
        F.max("len").alias("max_chars"),
        F.min("len").alias("min_chars"),
        F.percentile("len", F.lit(0.5), F.col("n")).alias("median_chars"),
    ).where(F.col("n_chunks") > 0)


def _ranges(counts: DataFrame) -> DataFrame:
    """Per measure: range and moments. Two rows."""
    n, x = F.col("n"), F.col("len")
    r = counts.groupBy("measure").agg(
        F.min("len").alias("lo"), F.max("len").alias("hi"),
        F.sum("n").alias("total"), F.sum(n * x).alias("s1"), F.sum(n * x * x).alias("s2"),
    )
    return r


def length_histogram(chunks: DataFrame, text_col: str = "text", bins: int = BINS) -> DataFrame:
    """``(measure, bin, lo, hi, n)``: equal-width bins from min to max, zeros kept.

    The last bin is closed on the right. With one distinct length the range is
    widened by a half on both sides, as histogram libraries do.
    """
    counts = length_counts(chunks, text_col)
    flat = F.col("lo") == F.col("hi")
    edges = _ranges(counts).select(
        "measure",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double")).alias("start"),
        F.when(flat, F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")).cast("double")).alias("span"),
    )
    binned = (
        counts.join(edges, "measure")
        .select(
            "measure",
            F.least(
                F.floor((F.col("len") - F.col("start")) * bins / F.col("span")), F.lit(bins - 1)
            ).alias("bin"),
            "n",
        )
        .groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    )
    grid = edges.select(
        "measure", "start", "span",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"),
    )
    edge = lambda i: F.col("start") + F.col("span") * i / bins
    return grid.join(binned, ["measure", "bin"], "left").select(
        "measure", "bin",
        edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def length_density(
    chunks: DataFrame,
    text_col: str = "text",
    grid_size: int = 200,
    bandwidth: float | None = None,
) -> DataFrame:
    """Gaussian kernel density of the lengths: ``(measure, grid, x, density)``.

    ``bandwidth`` is the kernel's standard deviation; the default is Scott's
    rule, ``n^(-1/5)`` times the sample standard deviation. The grid runs from
    the shortest to the longest length. No rows where all lengths are equal.
    """
    counts = length_counts(chunks, text_col)
    total = F.col("total").cast("double")
    var = (F.col("s2") - F.col("s1") * (F.col("s1") / total)) / (total - 1)
    h: Column = F.lit(bandwidth) if bandwidth else F.pow(total, F.lit(-0.2)) * F.sqrt(var)
    shape = _ranges(counts).where("hi > lo").select("measure", "lo", "hi", "total", h.alias("h"))
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid_size - 1).cast("bigint")))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("grid") / F.lit(float(grid_size - 1))
    z = (F.col("x") - F.col("len")) / F.col("h")
    return (
        counts.join(shape, "measure")
        .select("measure", "len", "n", "lo", "hi", "total", "h", steps.alias("grid"))
        .withColumn("x", x)
        .groupBy("measure", "grid", "x", "total", "h")
        .agg(F.sum(F.col("n") * F.exp(z * z * -0.5)).alias("mass"))
        .select(
            "measure", "grid", "x",
            (F.col("mass") / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi)))
            .alias("density"),
        )
    )
