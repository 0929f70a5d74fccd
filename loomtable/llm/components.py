"""Connected components of links between texts, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); the label is the component's least node.

    Every round takes the least label among neighbours and then the label of the label, so rounds grow
    with the logarithm of a component's diameter. Labels are settled each round; an empty table of
    links gives none. Loops and repeated links do no harm.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("hook"))
        jumped = hooked.join(labels.select(F.col("node").alias("hook"), F.col("label").alias("next")), "hook", "left")
        new = settle(jumped.select("node", F.coalesce("next", "hook").alias("label"), (F.coalesce("next", "hook") != F.col("old")).alias("moved")))
        if not new.filter("moved").take(1):
            return new.select("node", "label")
        labels = new.select("node", "label")
