"""Connected components of a graph of ids, as iterated joins with minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut


def fresh(col: str):
    """The column anew, so that a join deals its rows out by it again and can split a hot key."""
    return F.col(col).bitwiseXOR(F.lit(0).cast("bigint")).alias(col)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for each id in an edge; root is the smallest id reachable.

    Edges may be repeated and in either direction. Loops are allowed; an id only in loops is its own
    root. Each round takes the least label among the neighbours and then the label of the label, and
    is cut by a checkpoint; the driver sees only the number of changes.
    """
    both = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).unionByName(edges.select(F.col(v).alias("u"), F.col(u).alias("v")))
    both = cut(both.groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"))
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    while True:
        near = both.join(labels.select(fresh("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        least = labels.join(near, labels["node"] == near["u"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("least"))
        ahead = labels.select(fresh("node").alias("least"), F.col("root").alias("ahead"))
        labels = cut(least.join(ahead, "least").select("node", F.least("least", "ahead").alias("root"), "was"))
        changes = labels.filter(F.col("root") != F.col("was")).count()
        labels = labels.select("node", "root")
        if not changes:
            return labels
