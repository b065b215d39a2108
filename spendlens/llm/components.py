"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of
    ``edges`` (``a``, ``b``, long).

    Every round takes the smallest label among a node and its neighbours and
    then follows the label's own label, so labels travel twice as far each
    round.  Rounds are stored tables in the shared folder; only a count of
    changes reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stored(both.where("a <> b").distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = (links.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
