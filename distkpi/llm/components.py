"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from distkpi.llm.common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the edges; the root is the component's smallest node.

    Each round gives every node the smallest label among its neighbours, then
    replaces every label by the label's own label, so chains shorten by more
    than half. A round is written to the shared folder; the driver sees only
    the number of labels that changed.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = materialize(both.union(both.select("v", "u")).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("m"))
        hooked = labels.join(near, F.col("node") == F.col("u")).select(
            "node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        hooked, old = materialize(hooked, "labels"), labels
        up = hooked.select(F.col("node").alias("p"), F.col("root").alias("pr"))
        labels = materialize(hooked.join(up, F.col("root") == F.col("p"), "left").select(
            "node", "was", F.least("root", F.coalesce("pr", "root")).alias("root")), "labels")
        discard(old, hooked)
        if labels.filter("was <> root").isEmpty():
            discard(both)
            return labels.select("node", "root")
