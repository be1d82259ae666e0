"""Connected components of a graph of links, with nothing collected.

Labels are minimum ids: each round takes the smallest label among a node's neighbours, then
jumps to the label's own label.  Rounds go on until no label changes; each is written to the
shared folder, so lineage stays short and an executor may be lost at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm.tables import Staged


def components(links: DataFrame) -> Staged:
    """(id, component) of every node of ``links`` (a, b); component is the smallest id reachable.

    Loops, repeated links and either direction are allowed; links with a null end are ignored.
    """
    links = links.select("a", "b").dropna().where("a <> b")
    both = Staged(links.union(links.select("b", "a")).distinct(), "links")
    edges = both.read().select(F.col("a").alias("id"), F.col("b").alias("other"))
    labels = Staged(edges.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")), "labels")
    while True:
        old = labels.read()
        seen = edges.join(old.select(F.col("id").alias("other"), F.col("component").alias("near")), "other")
        best = seen.groupBy("id").agg(F.min("near").alias("near"))
        lower = old.join(best, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        above = old.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = Staged(
            lower.join(above, "component", "left").select("id", "was", F.least("component", "top").alias("component")), "labels"
        )
        moved = new.read().where("component <> was").limit(1).count()
        labels.remove()
        labels = new
        if not moved:
            both.remove()
            return labels
