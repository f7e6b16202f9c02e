"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.session import land


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links`` (columns ``a``, ``b``).

    The component is the smallest node reachable. Each round takes the smallest
    label among neighbours and then that label's own label, so labels travel
    ever longer distances; every round is written to the shared folder. A node
    with very many neighbours is met by partial minima and by joins that may be split.
    """
    ends = land(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "ends",
    )
    labels = land(
        ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"),
        "labels",
    )
    while True:
        near = (
            ends.join(labels, ends["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        seen = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("step")
        )
        own = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        labels = land(
            seen.join(own, seen["step"] == own["at"], "left").select(
                "node", "old", F.least("step", F.coalesce("jump", "step")).alias("component")
            ),
            "labels",
        )
        if labels.where("component <> old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
