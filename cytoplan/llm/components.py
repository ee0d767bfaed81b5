"""Connected components by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node of the connected set) for every node of edges; nulls are left out, directions and repeats don't matter.

    Each round takes the least label of the neighbours and then the label of that label, so rounds grow with the logarithm of the longest
    path; it ends when no label changes. Labels are cut into the shared folder each round; only the number of changes reaches the driver.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    ends = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    both = cut(pairs.select(ends.alias("e")).select("e.*").filter("x is not null").distinct())
    labels = cut(both.select(F.col("x").alias("node")).distinct().withColumn("component", F.col("node")))
    both = both.filter("y is not null and x <> y")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("__near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("__old"), F.least("component", "__near").alias("__new"))
        up = step.select(F.col("node").alias("__new"), F.col("__new").alias("__up"))
        step = cut(step.join(up, "__new").select("node", F.least("__new", "__up").alias("component"), (F.least("__new", "__up") != F.col("__old")).alias("__changed")))
        labels = step.select("node", "component")
        if step.filter("__changed").limit(1).count() == 0:
            return labels
