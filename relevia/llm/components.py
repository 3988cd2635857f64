"""Connected components of a link table, by least labels and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.session import materialize


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` of all nodes in ``links`` (columns a, b): the least node of each component.

    A node with very many links sends one least label per task. Rounds grow with the logarithm
    of the longest chain; every round is a table in the shared folder, and only the number of
    changed rows reaches the driver.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-links"
    )
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    labels = materialize(least.select("node", F.least("node", "b").alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("hook"))
        # a node's hook jumps to the label that the hook itself has
        jump = labels.select(F.col("node").alias("hook"), F.col("label").alias("far"))
        step = step.join(jump, "hook").select(
            "node", F.least("hook", "far").alias("label"), (F.least("hook", "far") < F.col("label")).alias("changed")
        )
        step = materialize(step, f"{name}-labels")
        labels = step.select("node", "label")
        if step.filter("changed").isEmpty():
            return labels
