"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``node, comp`` for every node of the links ``a, b`` (longs): the smallest node that can be reached.

    Every round takes the smallest label of all neighbours (combined before the shuffle), then the label's label. Labels are written
    after each round, so a lost executor costs one round. Stops when a round changes nothing; more than ``most_rounds`` is an error.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        joined = labels.join(near, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("to"))
        step = joined.join(jump, F.col("low") == F.col("at")).select("node", F.col("comp").alias("was"), F.least("low", "to").alias("comp"))
        step = cut(step)
        labels = step.select("node", "comp")
        if step.where("was <> comp").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
