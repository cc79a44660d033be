"""Connected components of a graph of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _summed(labels: DataFrame) -> tuple[DataFrame, object]:
    """The labels as a written table, and their sum, which the same job has found."""
    seen = Observation()
    out = written(labels.observe(seen, F.sum(F.col("component").cast("decimal(20,0)")).alias("total")), "labels")
    return out, seen.get["total"]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node.

    Each round takes the smallest label among a node and its neighbours and then that label's own
    label, so stars end after two rounds and long chains after a number that grows with their
    logarithm.  Every round is cut off from the ones before by a written table, and counts what
    it has changed while it writes.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(edges, "edges")
    labels = edges.groupBy("a").agg(F.min("b").alias("m"))
    labels, total = _summed(labels.select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        around = edges.join(labels, F.col("b") == F.col("node")).select("a", F.col("component").alias("m"))
        own = labels.select(F.col("node").alias("a"), F.col("component").alias("m"))
        near = around.union(own).groupBy("a").agg(F.min("m").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        new = near.join(up, "component").select(F.col("a").alias("node"), F.least("component", "jump").alias("component"))
        labels, now = _summed(new)
        # labels only ever fall, so their sum tells whether one has
        if now == total:
            return labels
        total = now
