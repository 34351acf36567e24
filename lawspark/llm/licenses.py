"""License scans by ordered signature rules.

A rule is a regular expression with a label, a keyword and a priority. A rule
is tried on a text only if the text has the rule's keyword, and a text only if
it has any gate word; so most texts meet no rule. Both are necessary: whatever
the pattern matches holds its keyword, a word without blanks, and a gate word. The rules come from a table
of licenses and a table of forms (SPDX tag, full name with version, licensing
sentence, name, address). All matches of all rules are intervals; a match that
lies inside the match of a rule of at least its priority is suppressed, which
one pass over the intervals in order of place decides.

Beside them stand the *base* phrases, whose words must be consecutive words of
the text. Only column expressions and aggregations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawspark.llm.decontam import words
from lawspark.session import written

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# label: (keyword, name pattern, versions, address)
LICENSES: dict[str, tuple[str, str, tuple[str, ...], str]] = {
    "gpl": ("gnu", r"gnu\s+general\s+public\s+licen[cs]e", ("1", "2", "3"), r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    "lgpl": ("gnu", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e", ("2", "2.1", "3"), r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    "agpl": ("gnu", r"gnu\s+affero\s+general\s+public\s+licen[cs]e", ("1", "3"), r"gnu\.org/licenses/agpl"),
    "gfdl": ("gnu", r"gnu\s+free\s+documentation\s+licen[cs]e", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/fdl"),
    "apache": ("apache", r"apache\s+(?:software\s+)?licen[cs]e", ("1.0", "1.1", "2.0"), r"apache\.org/licenses/"),
    "mit": ("mit", r"mit\s+licen[cs]e", (), r"opensource\.org/licenses?/mit"),
    "isc": ("isc", r"isc\s+licen[cs]e", (), r"opensource\.org/licenses?/isc"),
    "bsd": ("bsd", r"bsd\s+licen[cs]e", ("0-clause", "2-clause", "3-clause", "4-clause"), r"opensource\.org/licenses?/bsd"),
    "mpl": ("mozilla", r"mozilla\s+public\s+licen[cs]e", ("1.0", "1.1", "2.0"), r"mozilla\.org/mpl"),
    "epl": ("eclipse", r"eclipse\s+public\s+licen[cs]e", ("1.0", "2.0"), r"eclipse\.org/legal/epl"),
    "cddl": ("distribution", r"common\s+development\s+and\s+distribution\s+licen[cs]e", ("1.0", "1.1"), r"opensource\.org/licenses?/cddl"),
    "cpl": ("common", r"common\s+public\s+licen[cs]e", ("1.0",), r"opensource\.org/licenses?/cpl"),
    "eupl": ("union", r"european\s+union\s+public\s+licen[cs]e", ("1.0", "1.1", "1.2"), r"eupl\.eu"),
    "artistic": ("artistic", r"artistic\s+licen[cs]e", ("1.0", "2.0"), r"opensource\.org/licenses?/artistic"),
    "boost": ("boost", r"boost\s+software\s+licen[cs]e", ("1.0",), r"boost\.org/license"),
    "zlib": ("zlib", r"zlib(?:/libpng)?\s+licen[cs]e", (), r"zlib\.net/zlib_license"),
    "unlicense": ("unlicense", r"the\s+unlicense", (), r"unlicense\.org"),
    "wtfpl": ("fuck", r"do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+licen[cs]e", ("1", "2"), r"wtfpl\.net"),
    "python": ("python", r"python\s+(?:software\s+foundation\s+)?licen[cs]e", ("2",), r"python\.org/psf/license"),
    "postgresql": ("postgresql", r"postgresql\s+licen[cs]e", (), r"postgresql\.org/about/licen[cs]e"),
    "openssl": ("openssl", r"openssl\s+licen[cs]e", (), r"openssl\.org/source/license"),
    "php": ("php", r"php\s+licen[cs]e", ("3.0", "3.01"), r"php\.net/license"),
    "ruby": ("ruby", r"ruby\s+licen[cs]e", (), r"ruby-lang\.org/en/about/license"),
    "ofl": ("font", r"sil\s+open\s+font\s+licen[cs]e", ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    "osl": ("software", r"open\s+software\s+licen[cs]e", ("1.0", "1.1", "2.0", "2.1", "3.0"), r"opensource\.org/licenses?/osl"),
    "afl": ("academic", r"academic\s+free\s+licen[cs]e", ("1.1", "1.2", "2.0", "2.1", "3.0"), r"opensource\.org/licenses?/afl"),
    "ms-pl": ("microsoft", r"microsoft\s+public\s+licen[cs]e", (), r"opensource\.org/licenses?/ms-pl"),
    "ms-rl": ("microsoft", r"microsoft\s+reciprocal\s+licen[cs]e", (), r"opensource\.org/licenses?/ms-rl"),
    "ncsa": ("ncsa", r"ncsa\s+open\s+source\s+licen[cs]e", (), r"opensource\.org/licenses?/ncsa"),
    "cecill": ("cecill", r"cecill(?:-[bc])?", ("1.0", "1.1", "2.0", "2.1"), r"cecill\.info"),
    "odbl": ("database", r"open\s+database\s+licen[cs]e", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    "odc-by": ("commons", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", ("1.0",), r"opendatacommons\.org/licenses/by"),
    "bsl": ("business", r"business\s+source\s+licen[cs]e", ("1.1",), r"mariadb\.com/bsl11"),
    "sspl": ("server", r"server\s+side\s+public\s+licen[cs]e", ("1",), r"mongodb\.com/licensing"),
    "ipl": ("ibm", r"ibm\s+public\s+licen[cs]e", ("1.0",), r"opensource\.org/licenses?/ipl"),
    "x11": ("x11", r"x11\s+licen[cs]e", (), r"x\.org/archive/x11.{0,20}license"),
    "public-domain": ("domain", r"(?:released|dedicated|placed)\s+(?:in|in?to)\s+the\s+public\s+domain", (), r"creativecommons\.org/publicdomain/mark"),
    "cc0": ("cc", r"(?:cc0|cc\s+zero)", ("1.0",), r"creativecommons\.org/publicdomain/zero"),
}
_CC_PARTS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderiv(?:ative)?s"}


def _creative_commons() -> list[tuple[str, str, str, tuple[str, ...], str]]:
    """Each licence of the family, by its short and by its long name."""
    out = [("cc0", "creative", r"creative\s+commons\s+zero", *LICENSES["cc0"][2:])]
    for parts in (["by"], ["by", "sa"], ["by", "nc"], ["by", "nd"], ["by", "nc", "sa"], ["by", "nc", "nd"]):
        label, versions = "-".join(["cc", *parts]), ("1.0", "2.0", "2.5", "3.0", "4.0")
        address = "creativecommons\\.org/licenses/" + "-".join(parts) + "/"
        out.append((label, "cc", r"[\s-]+".join(["cc", *parts]), versions, address))
        long = r"[\s-]+".join(_CC_PARTS[x] for x in parts)
        out.append((label, "creative", r"creative\s+commons\s+" + long, versions, address))
    return out


# What a text must hold for any rule to match: a part of every name and of every address.
GATES = (
    r"(?i)licen|copyright|cecill|public\s+domain|cc0|cc\s+zero|cc[\s-]+by|creative\s*commons|mozilla\.org/mpl"
    r"|eclipse\.org/legal/epl|eupl\.eu|wtfpl\.net|scripts\.sil\.org/ofl|mariadb\.com/bsl11"
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int  # 3 tag or address, 2 sentence or version, 1 name alone
    confidence: float


def rules() -> list[Rule]:
    """All rules, in order: each license in each of its forms."""
    out = []
    table = [(label, *row) for label, row in LICENSES.items()]
    for label, keyword, name, versions, address in table + _creative_commons():
        out.append(Rule(label, "spdx", rf"spdx-license-identifier:\s*{label}(?:-[0-9][a-z0-9.-]*)?\b", 3, 1.0))
        out.append(Rule(label, address.split("\\")[0].split(".")[0], rf"\b{address}", 3, 0.95))
        for v in versions:
            number = v.replace(".", r"\.") + (r"(?:\.0)?" if v.isdigit() else "") + r"(?![0-9.]*[0-9])"
            full = f"{label}-{v}"
            out.append(Rule(full, keyword, rf"\b{name},?\s+(?:version\s+|v\.?\s*)?{number}", 2, 0.9))
        out.append(Rule(label, keyword, rf"\b(?:licen[cs]ed|released|distributed|available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{name}\b", 2, 0.85))
        out.append(Rule(label, keyword, rf"\b{name}\b", 1, 0.6))
    out.append(Rule("proprietary", "copyright", r"\bcopyright\b.{0,80}\ball\s+rights\s+reserved\b", 1, 0.4))
    return out


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table, one row each; their number is fixed."""
    rows = ", ".join(
        f"({i}, '{r.label}', '{r.keyword}', r'(?is){r.pattern}', {r.priority}, {r.confidence}D)"
        for i, r in enumerate(rules())
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(i, label, keyword, pattern, priority, confidence)")


def gated(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, text``: the text only where a gate word occurs; written once."""
    text = F.coalesce("text", F.lit(""))
    # A-Z and a-z alike are word characters, so counting needs no lower-casing.
    n = F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"))
    # A base phrase may stand across any signs; its rarest words gate it.
    gate = text.rlike(GATES) | text.rlike(r"(?i)cc[^a-z0-9\x{80}-\x{10FFFF}]+by")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_words"),
        F.when(gate, text).alias("text"),
    )
    return written(rows, "gated")


def _base(rows: DataFrame) -> DataFrame:
    """``row, n_base, first_word, last_word, base`` of gated rows with a base phrase."""
    def places(w: Column) -> Column:
        return F.concat(*[_places(w, phrase.split(), label) for phrase, label in BASE.items()])

    # An array of one binds the words, so that they are made once per text.
    p = F.transform(F.array(words(F.col("text"))), places)[0]
    found = rows.select("row", p.alias("p")).where(F.size("p") > 0)
    return found.select(
        "row", F.size("p").cast("long").alias("n_base"), F.array_min("p.at").alias("first_word"),
        F.array_max("p.at").alias("last_word"), F.array_sort(F.array_distinct("p.label")).alias("base"),
    )


def _places(w: Column, parts: list[str], label: str) -> Column:
    """Where the words ``parts`` stand consecutively in ``w``."""
    def stands(i: Column) -> Column:
        out = F.lit(True)
        for k, part in enumerate(parts):
            out = out & F.try_element_at(w, i + F.lit(k + 1)).eqNullSafe(F.lit(part))
        return out

    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - len(parts), F.lit(0)))
    return F.transform(
        F.filter(starts, stands), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))
    )


def detections(rows: DataFrame) -> DataFrame:
    """``row, label, start, end, priority, confidence``: matches that none of at least their priority contains."""
    # Which keywords a text has, then the rules of those.
    words_asked = F.array(*[F.lit(k) for k in sorted({r.keyword for r in rules()})])
    low = rows.select("row", "text", F.lower("text").alias("low"))
    keyed = low.select("row", "text", F.explode(F.filter(words_asked, lambda k: F.col("low").contains(k))).alias("keyword"))
    tried = keyed.join(F.broadcast(rule_table(rows.sparkSession)), "keyword")
    hit = tried.where(F.rlike("text", F.col("pattern"))).select(
        "row", "i", "label", "priority", "confidence", F.expr("regexp_extract_all(text, pattern, 0)").alias("m"),
        F.expr("split(text, pattern)").alias("gap"),
    )
    rule = ["row", "i", "label", "priority", "confidence"]
    each = hit.select(*rule, F.posexplode(F.expr(
        "transform(m, (x, i) -> struct(length(gap[i]) as before, length(x) as size))"
    )).alias("k", "x"))
    so_far = Window.partitionBy("row", "i").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.before") + F.col("x.size")).over(so_far)
    spans = each.select(*rule, end.alias("end"), (end - F.col("x.size")).alias("start"))
    before = (
        Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "i")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.lit(False)
    for level in (3, 2, 1):
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before)
        covered = covered | F.coalesce((F.col("priority") == level) & (reach >= F.col("end")), F.lit(False))
    return spans.withColumn("covered", covered).where("not covered").drop("covered", "i")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found`` per row.

    Null texts are empty, ids may be null or repeated. ``score`` is the highest
    confidence of the matches left, 0.6 for a base phrase alone, else 0;
    ``found`` holds the matches as code points, end exclusive.
    """
    rows = gated(docs)
    some = rows.where(F.col("text").isNotNull())
    kept = detections(some)
    per_row = kept.groupBy("row").agg(
        F.collect_set("label").alias("own"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("found"),
    )
    none = F.array().cast("array<string>")
    base, own = F.coalesce("base", none), F.coalesce("own", none)
    out = rows.drop("text").join(_base(some), "row", "left").join(per_row, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(F.coalesce("confidence", F.lit(0.0)), F.when(F.size(base) > 0, 0.6).otherwise(0.0)).alias("score"),
        "found",
    )
