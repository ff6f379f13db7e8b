"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import finished, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b), for every node of a link.

    Each round a node takes the least label among its own, its neighbours' and its label's; so chains shorten by more
    than half. Every round is one aggregation, written to the shared folder; the driver sees one number a round. Nodes
    may be of any type with an order. Minima over a hub's links are partial before they move.
    """
    return finished(lambda: _labels(links))


def _labels(links: DataFrame) -> DataFrame:
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near"))))
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("near")).alias("component")))
    while True:
        label = labels.select(F.col("node").alias("near"), F.col("component").alias("value"))
        jump = labels.select("node", F.col("component").alias("near")).join(label, "near").select("node", "value")
        own = labels.select("node", F.col("component").alias("value"), F.col("component").alias("old"))
        told = both.join(label, "near").select("node", "value").unionByName(jump).unionByName(own, allowMissingColumns=True)
        moved = Observation()
        step = told.groupBy("node").agg(F.min("value").alias("component"), F.max("old").alias("old"))
        labels = stored(step.observe(moved, F.count(F.when(F.col("component") < F.col("old"), 1)).alias("n"))).select("node", "component")
        if not moved.get["n"]:
            return labels
