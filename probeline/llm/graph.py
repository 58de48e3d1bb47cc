"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from probeline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the undirected edges ``a, b``; ``comp`` is the smallest node.

    Each round takes the smallest label among the neighbours, then the label of that label, so labels travel
    twice as far each round. Rounds are written to the shared folder. Rows are pre-aggregated before a shuffle.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).selectExpr("node", "least(node, m) AS comp"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        )
        met = labels.join(near, "node").selectExpr("node", "comp AS old", "least(comp, near) AS comp")
        jump = labels.selectExpr("node AS comp", "comp AS next")
        new = stored(met.join(jump, "comp").selectExpr("node", "old", "least(comp, next) AS comp"), "labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels
