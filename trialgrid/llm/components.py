"""Connected components of a table of links, by DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.session import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in links (a, b).

    Each round an id takes the smallest label among its neighbours', then that
    label's own label (pointer jumping), so the number of rounds follows the
    logarithm of the longest chain. The table of a round is written once."""
    edges = written(links.where("a <> b").select("a", "b").unionAll(links.where("a <> b").select("b", "a")).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("id"))
                     .agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near")))
        moved = (labels.join(near, labels["id"] == near["a"])
                 .select("id", F.col("component").alias("before"), F.least("component", "near").alias("next")))
        target = labels.select(F.col("id").alias("target"), F.col("component").alias("beyond"))
        jumped = written(moved.join(target, moved["next"] == target["target"], "left")
                         .select("id", "before", F.least("next", F.coalesce("beyond", "next")).alias("component")), "labels")
        labels = jumped.select("id", "component")
        if jumped.where("before <> component").isEmpty():
            return labels
