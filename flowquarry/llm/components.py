"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import drop_stored, stored


def connected_components(links: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links(a, b)``; component is the smallest node reachable.

    Each round hands every node the smallest label of its neighbours and then follows labels to their
    own labels, so long chains shrink by a power each round. Rounds go on until nothing changes.
    Every join reads both sides straight from stored tables, so Spark can split the partitions of a hot
    node; minima are combined before they are shuffled. Self links and repeated links do no harm; links
    with a null end are ignored; an empty table gives an empty result.
    """
    clean = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = stored(clean.union(clean.select("b", "a")).distinct(), "links")
    labels = stored(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels"
    )
    while True:
        hops = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = stored(labels.join(hops, "component").select("node", F.col("next").alias("component")), "labels")
        offers = (
            edges.join(jumped.withColumnRenamed("node", "a"), "a")
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("component").alias("offer"))
        )
        updated = stored(
            jumped.join(offers, "node").select(
                "node", F.least("component", "offer").alias("component"), (F.col("offer") < F.col("component")).alias("moved")
            ),
            "labels",
        )
        moving = updated.where("moved").limit(1).count()
        for old in (labels, jumped):
            drop_stored(old)
        labels = updated.select("node", "component")
        if not moving:
            return labels
