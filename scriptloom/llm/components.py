"""Connected components of an undirected graph, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node reachable.

    Each round takes the least label among a node and its neighbours and then the label of
    that label, until nothing changes. Every round is kept in the shared folder, and joins
    read plain kept frames, so that Spark can split a label that many nodes have.
    """
    both = durable(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .filter("node <> other")
        .distinct()
    )
    labels = durable(
        both.groupBy("node")
        .agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("root"))
    )
    while True:
        near = durable(
            both.join(labels.select(F.col("node").alias("other"), "root"), "other")
            .groupBy("node")
            .agg(F.min("root").alias("near"))
        )
        lower = durable(
            labels.join(near, "node").select(
                "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
            )
        )
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = durable(
            lower.join(jump, "root", "left").select(
                "node", "old", F.least("root", F.coalesce("next", "root")).alias("root")
            )
        )
        labels = after.select("node", "root")
        if after.filter("root <> old").isEmpty():
            return labels
