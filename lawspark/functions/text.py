"""Text expressions: whitespace, tokens, Roman numerals, term counts.

Everything here is a Column expression of built-in functions, so it stays in
the JVM and can be used in batch and in streaming plans alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace, once for use inside
# [...] of a pattern (Java's \s is ASCII only) and once as a set to trim.
WS = r"\s\x1c-\x1f\x85\p{Z}"
WS_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

_WS_SET = "".join(map(chr, WS_POINTS))
_NOT_WORD = rf"[^\p{{L}}\p{{N}}_{WS}]"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace on both ends (plain ``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(_WS_SET))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.array_remove(F.split(text, f"[{WS}]+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def word_text(text: Column) -> Column:
    """Lower case, non-word characters deleted.

    They are deleted and not replaced by a blank: ``a/b`` gives ``ab``.
    """
    return F.regexp_replace(F.lower(text), _NOT_WORD, "")


def tokens(text: Column) -> Column:
    """Lexical tokens: ``word_text`` split on space."""
    return words(word_text(text))


def lines(text: Column) -> Column:
    """Stripped, non-empty lines in order."""
    return F.array_remove(F.transform(F.split(text, "\n"), strip), "")


def roman_to_int(numeral: Column) -> Column:
    """Subtractive Roman numeral read from the right; unknown letters count 0."""
    # The letters of Roman numerals.
    worth = F.create_map(*[
        F.lit(x) for pair in
        (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))
        for x in pair
    ])
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("highest"))

    def step(acc: Column, value: Column) -> Column:
        smaller = value < acc["highest"]
        return F.struct(
            F.when(smaller, acc["total"] - value).otherwise(acc["total"] + value).alias("total"),
            F.when(smaller, acc["highest"]).otherwise(value).alias("highest"),
        )

    values = F.transform(
        F.reverse(F.split(F.upper(numeral), "")), lambda c: F.coalesce(worth[c], F.lit(0))
    )
    return F.aggregate(values, start, step, lambda acc: acc["total"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An outer expression used inside a lambda is computed at each call of the
    lambda, so a lambda's own variable must hold it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(tokens_col: Column) -> Column:
    """``array<struct<term,tf>>`` of an array of tokens, inside the row.

    The tokens are sorted, then cut where neighbours differ: one sort and two
    linear passes, no shuffle.
    """
    def starts(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def counts(s: Column, at: Column) -> Column:
        return F.transform(at, lambda i, j: F.struct(
            F.get(s, i).alias("term"),
            (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("bigint").alias("tf"),
        ))

    return let(F.sort_array(tokens_col), lambda s: let(starts(s), lambda at: counts(s, at)))


def segment(text: Column, open_segmenter: Callable[[], Callable[[list[str]], list[str]]] | None) -> Column:
    """Word segmentation by a caller's function, identity without one.

    ``open_segmenter`` is called once per task and returns a function from a
    list of texts to a list of segmented texts (compounds joined by ``_``).
    """
    if open_segmenter is None:
        return text

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        segmenter = open_segmenter()
        for batch in batches:
            yield pd.Series(segmenter(batch.fillna("").tolist()))

    return run(text)


def is_json_object(text):
    """One complete JSON object in strict form, with nothing after it; never null.

    The parser stops at the end of a value. As the only element of an array
    and as the only value of an object the text must end where they do.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    valued = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    kind = F.schema_of_variant(F.try_variant_get(alone, "$[0]", "variant"))
    only = F.try_variant_get(alone, "$[1]", "variant").isNull()
    return F.coalesce(valued.isNotNull() & only & kind.startswith("OBJECT"), F.lit(False))
