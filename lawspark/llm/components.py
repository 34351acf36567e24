"""Connected components of a table of links, by hooking and contraction.

Each round every label hooks onto its smallest linked label, labels follow two
hooks at once, and links inside one label vanish. All steps are joins and
minima combined before the shuffle; results of a round are written to the
shared folder, so nothing long is recomputed and no part is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawspark.session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)``; the root is its smallest node."""
    links = links.select("a", "b").where("a <> b")
    label = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = label.select("node", F.col("node").alias("root"))
    rest = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    while True:
        hook = written(rest.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        if hook.isEmpty():
            return label
        far = hook.select(F.col("hi").alias("lo"), F.col("lo").alias("lower"))
        hop = written(
            hook.join(far, "lo", "left").select("hi", F.coalesce("lower", "lo").alias("to")), "hops"
        )
        to = hop.select(F.col("hi").alias("root"), "to")
        label = written(
            label.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")),
            "labels",
        )
        first = hop.select("hi", F.col("to").alias("x"))
        second = hop.select(F.col("hi").alias("lo"), F.col("to").alias("y"))
        moved = rest.join(first, "hi").join(second, "lo", "left")  # every hi has a hook
        y = F.coalesce("y", "lo")
        rest = written(
            moved.where(F.col("x") != y)
            .select(F.greatest("x", y).alias("hi"), F.least("x", y).alias("lo")).distinct(),
            "links",
        )
