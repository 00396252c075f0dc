"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node that can be reached.

    Each round, a node takes the smallest label around it, then the label of its label.  Minima are
    combined before they are shuffled, so a node with very many links is no hot spot.
    """
    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = durable(pairs.filter("a <> b").distinct())
    labels = durable(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        around = pairs.join(labels, pairs["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        taken = durable(taken)
        jump = taken.select(F.col("node").alias("root"), F.col("label").alias("further"))
        jumped = taken.join(jump, taken["label"] == jump["root"], "left").select("node", "old", F.least("label", "further").alias("label"))
        jumped = durable(jumped)
        labels = jumped.select("node", "label")
        if jumped.filter("label < old").isEmpty():
            return labels
