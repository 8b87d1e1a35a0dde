"""Connected components of a link table by least labels and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node of its component."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("to"))
    both = stored(ends.union(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "cc-labels")
    while True:
        seen = both.join(labels, "node").groupBy(F.col("to").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parents = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = step.join(parents, "label").select("node", "old", F.least("label", "up").alias("label"))
        after = stored(jumped, "cc-labels")
        if after.where("old <> label").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
