"""Connected components by contraction, as Spark joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.workspace import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(a, b)``.

    Each round hooks every node to its smallest neighbour, flattens the forest by
    pointer jumping and contracts the edges, so few rounds are needed whatever the
    diameter.  Only partial minima are aggregated and joins split skewed keys, so
    a hub with a third of all edges is no hot task.  Nulls and loops are ignored;
    an empty input gives an empty table.
    """
    cur = ws.write(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    labels = ws.write(cur.select(F.col("a").alias("node")).union(cur.select("b")).distinct().withColumn("component", F.col("node")))
    while not cur.isEmpty():
        both = cur.union(cur.select("b", "a"))
        parent = ws.write(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        )
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = ws.write(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            ws.drop(parent)
            parent = jumped
            if parent.where("moved").isEmpty():
                break
        to = parent.select(F.col("node").alias("component"), "up")
        relabelled = ws.write(labels.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        ws.drop(labels)
        labels = relabelled
        a, b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        joined = cur.join(a, "a").join(b, "b").where("up_a <> up_b")
        contracted = ws.write(joined.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        ws.drop(cur, parent)
        cur = contracted
    return labels
