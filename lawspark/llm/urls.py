"""URL filter: rules of hosts and paths, and boosted trees for the rest.

A rule ``host/path`` fits its host, all subdomains and the paths it begins;
the longest fitting rule decides. Where none fits, gradient-boosted trees on
lexical features decide: length, depth, share of digits, entropy of the
letters, number of parameters, hyphens and labels of the host, and statistics
of the host's suffix (its last label) over the whole table. Everything is a
column expression, an aggregation or a Spark ML model; no Python runs on rows.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_CLASS = 5000  # training urls of each class, about
TREES, DEPTH = 12, 3
FEATURES = [
    "length", "depth", "digit_share", "entropy", "parameters", "hyphens", "labels", "longest_label",
    "suffix_urls", "suffix_length", "suffix_digits",
]
_SIGNS = string.ascii_lowercase + string.digits + "-._/?=&%~+"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (``host/path``) that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character, over letters, digits and usual signs; other characters are left out."""
    size = F.greatest(F.length(text), F.lit(1))
    counts = F.transform(
        F.array(*[F.lit(s) for s in _SIGNS]), lambda s: F.length(text) - F.length(F.replace(text, s, F.lit("")))
    )
    return F.aggregate(
        counts, F.lit(0.0), lambda a, k: a + F.when(k > 0, -(k / size) * F.log2(k / size)).otherwise(0.0)
    )


def features(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path and the features; a null url has those of an empty one."""
    url = F.coalesce("url", F.lit(""))
    host, path = parts(url)
    return pages.withColumns({"host": host, "path": path}).withColumns({
        "__suffix": F.element_at(F.split("host", r"\."), -1),
        "length": F.length(url).cast("double"),
        "depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"),
        "digit_share": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(F.lower(url)),
        "parameters": F.regexp_count(url, F.lit("[?&][^=&#]+")).cast("double"),
        "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)).cast("double"),
    })


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """Per host suffix, over all rows: number of urls, mean length, mean share of digits."""
    return rows.groupBy("__suffix").agg(
        F.log2(F.count("*")).alias("suffix_urls"), F.avg("length").alias("suffix_length"),
        F.avg("digit_share").alias("suffix_digits"),
    )


def train(rows: DataFrame, label: Column, per_class: int = PER_CLASS) -> GBTClassificationModel | None:
    """Boosted trees from about ``per_class`` urls of each label (0 or 1) at most; null labels are unused.

    The sample is taken by a hash of the url. None if only one label occurs.
    """
    known = rows.withColumn("__y", label.cast("double")).where("__y is not null").select("url", *FEATURES, "__y")
    count = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if len(count) < 2:
        return None
    deal = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("__y") == 1, min(1.0, per_class / count[1.0])).otherwise(min(1.0, per_class / count[0.0]))
    sample = known.where(deal < share).select(*FEATURES, "__y").orderBy(*FEATURES, "__y").coalesce(1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(sample).select("__x", "__y")
    trees = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1)
    return trees.fit(vectors)


def judge(rows: DataFrame, model: GBTClassificationModel | None, rules: dict[str, str]) -> DataFrame:
    """``rows`` with ``rule``, ``verdict`` and ``score`` (the trees' chance of block; 0 without a model)."""
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        given = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(rows)
        model = model.setFeaturesCol("__x").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__c")
        scored = model.transform(given).withColumn("score", vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__c")
    scored = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return scored.withColumn("verdict", verdict)
