"""Connected components of links kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.scratch import Scratch
from geoloom.llm.skew import attach


def connected(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node of its component.

    Each round takes the smallest label among neighbours, then the label of
    that label; the rounds end when nothing changes. Every round is a written
    table, so a lost executor repeats one round only.
    """
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    edges = both.count()
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    labels = scratch.keep(first.select("node", "degree", F.least("node", "m").alias("label")), f"{name}-0")
    k = 0
    while True:
        # A hub is the neighbour of many: its label is attached like that of a hot key.
        near = attach(both, labels.withColumnRenamed("node", "b"), "b", "degree", edges).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = scratch.keep(labels.join(near, "node").select("node", "degree", F.col("label").alias("was"), F.least("label", "near").alias("l")), f"{name}-near{k}")
        sizes = lower.groupBy("l").agg(F.count(F.lit(1)).alias("size"))
        jump = scratch.keep(sizes.join(lower.select(F.col("node").alias("l"), F.col("l").alias("jumped")), "l"), f"{name}-jump{k}")
        after = scratch.keep(attach(lower, jump, "l", "size", lower.count()).select("node", "degree", "was", F.least("l", "jumped").alias("label")), f"{name}-{k + 1}")
        changed = after.filter("was <> label").limit(1).count()
        for done in (f"{name}-{k}", f"{name}-near{k}", f"{name}-jump{k}"):
            scratch.drop(done)
        k += 1
        labels = after.drop("was")
        if not changed:
            return labels.select("node", "label")
