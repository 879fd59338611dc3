"""Connected components of an edge table.

Each round every node takes the least label among its own and its neighbours',
then the label of that label; rounds go on until nothing changes.  Labels are
cut from their lineage in reliable storage each round.  Joins have one row for
each key on one side, so hot nodes are left to the skew join; the minimum is
pre-aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the least node reachable, for each node of an edge."""
    edges = edges.filter("a <> b").select("a", "b")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("beyond"))
        moved = cut(taken.join(jump, "now", "left").select("node", "was", F.least("now", "beyond").alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("was <> component").isEmpty():
            return labels
