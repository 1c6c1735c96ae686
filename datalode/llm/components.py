"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalode.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Columns ``node`` and ``label`` (the component's smallest node) for each node of the links (a, b).

    Each round gives every node the smallest of itself and its neighbours, and links what remains
    different; the number of rounds grows with the logarithm of the longest path. Only a row's presence
    comes to the driver.
    """
    links = written(links.select("a", "b").where("a != b").distinct(), name)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    while True:
        step = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label")
        step = written(step, name)
        if labels is None:
            labels = step
        else:
            moved = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = written(labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label")), name)
        ends = both.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
        ends = ends.join(step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la != lb")
        both = written(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), name)
        if not both.head(1):
            return labels
