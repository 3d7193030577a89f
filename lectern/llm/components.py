"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lectern.session import materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, comp)`` for every node of ``edges (a, b)``; comp is the smallest node of its component.

    Each round takes the smallest label among neighbours and then the label's own label
    (pointer jumping), so that the number of rounds grows with the logarithm of a
    component's diameter. Each round is written to the shared folder. Rows with a null
    end are dropped; self loops give a component of one node; no edges, no rows.
    """
    e = edges.where("a is not null and b is not null").select("a", "b")
    both = materialize(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = step.join(up, "comp", "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        step = materialize(step, "labels")
        labels = step.select("node", "comp")
        if step.where("was <> comp").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
