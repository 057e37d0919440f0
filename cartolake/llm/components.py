"""Connected components of links, as joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label: the least node of its component.

    Each round gives a node the least label around it and then the label of its label, so long
    chains halve. Labels are written after each round; nothing but a flag comes to the driver.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = saved(labels)
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(around, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        heads = step.select(F.col("node").alias("head"), F.col("new").alias("head_new"))
        step = step.join(heads, F.col("new") == F.col("head")).select("node", "label", F.least("new", "head_new").alias("new"))
        step = saved(step)
        changed = step.filter("label <> new").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
