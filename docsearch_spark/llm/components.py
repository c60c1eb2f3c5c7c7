"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsearch_spark.llm.util import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b).

    Every round each node takes the smallest label among itself and its
    neighbours, and then that label's own label, so that paths shorten by half.
    Only nodes with a link are returned. Sums are partial before each shuffle,
    so a node with very many links costs no task more than its own rows.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"),
                                                                       F.col("a").alias("b")))
                       .where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    for _ in range(rounds):
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        stepped = labels.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        up = labels.select(F.col("id").alias("to"), F.col("component").alias("up"))
        fresh = materialize(stepped.join(up, "to").select(
            "id", "old", F.least("to", "up").alias("component")), "labels")
        labels = fresh.select("id", "component")
        if fresh.where("old <> component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
