"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) of every node in ``edges`` (a, b).

    Labels only fall, and following a label's own label halves the way that is left, so the rounds
    grow with the logarithm of the diameter.  Each round is a table of its own."""
    both = common.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = common.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("offer"))
        lower = labels.join(offered, labels["node"] == offered["a"]).select("node", F.least("comp", "offer").alias("new"), F.col("comp").alias("old"))
        over = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        after = lower.join(over, lower["new"] == over["_n"]).select("node", F.least("new", "_c").alias("comp"), "old")
        after = common.cut(after, "labels")
        labels = after.select("node", "comp")
        if after.where("comp <> old").isEmpty():
            return labels
