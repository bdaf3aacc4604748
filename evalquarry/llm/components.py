"""Connected components of an edge table, kept in tables from first to last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; only nodes of edges (x, y) appear.

    Each round takes the least label over neighbours and then the label of that label, and is
    written to the shared folder, so a round survives lost executors and lineage stays short. The
    number of rounds grows with the logarithm of the longest chain.
    """
    both = materialise(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = materialise(both.groupBy("x").agg(F.min("y").alias("l")).select(F.col("x").alias("node"), F.least("x", "l").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("root").alias("near"))
        met = labels.join(near, labels["node"] == near["x"]).select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        stepped = materialise(met.join(jump, "new").select("node", "root", F.least("new", "far").alias("to")), "labels")
        labels = stepped.select("node", F.col("to").alias("root"))
        if stepped.where("root <> to").isEmpty():
            return labels
