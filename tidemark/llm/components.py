"""Connected components as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.skew import join_hot
from tidemark.scratch import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Every round a node takes the smallest label among its neighbours and then the label of its label, so
    chains halve in each round.  A node with very many links, and a label that very many nodes have come to share, are
    joined without a shuffle (:func:`tidemark.llm.skew.join_hot`).  Rounds are written to the shared folder; only counts come to the driver.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).filter("u <> v").distinct()
    edges = scratch.table(both, "edges")
    # Every link is there from both ends, so a node has as many rows as "v" as it has neighbours.
    labels = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), "degree"), "labels")
    n_edges, n_nodes = edges.count(), labels.count()
    while True:
        near = join_hot(edges, labels.select(F.col("node").alias("v"), "label", "degree"), ["v"], n_edges, "degree").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"), "degree")
        step = scratch.table(step, "step")
        used = step.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = scratch.table(used.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label"), "jump")
        following = scratch.table(join_hot(step, jump, ["label"], n_nodes).select("node", "was", F.least("label", "further").alias("label"), "degree"), "labels")
        changed = following.filter("label <> was").limit(1).count()
        for old in (step, jump, labels):
            scratch.drop(old)
        labels = following
        if not changed:
            scratch.drop(edges)
            return labels.select("node", F.col("label").alias("component"))
