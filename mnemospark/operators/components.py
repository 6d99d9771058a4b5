"""Connected components of an edge table, by minimum labels and pointer jumping.

Labels live in written tables; nothing but counts reach the driver. Every round takes the least label of the neighbours (a
partial aggregate before its shuffle) and then the label of the label, so chains shorten by half or more each round. A
hub's edges, and the nodes that share one label, would meet in one task: both joins send hot keys out by a broadcast of
bounded size instead (``join_by_size``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.joins import join_by_size
from mnemospark.session import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node that it reaches."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "node")
    labels = written(labels, "labels")
    for _ in range(max_rounds):
        near = join_by_size(both.withColumnRenamed("b", "node"), labels, ["node"], "degree").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "degree", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        stepped = written(stepped, "labels")
        sizes = stepped.groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("label", "via")
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far")).join(sizes, "via").withColumnRenamed("via", "label")
        jumped = written(join_by_size(stepped, far, ["label"], "size").select("node", "degree", "old", F.least("label", "far").alias("label")), "labels")
        labels = jumped.select("node", "degree", "label")
        if jumped.filter(F.col("label") != F.col("old")).isEmpty():
            return labels.select("node", "label")
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
