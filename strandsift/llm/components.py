"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import drop, durable


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): component is the smallest id that can be reached.

    Each round takes the least label over the neighbours and then the label of the label, so a chain of n edges
    takes about log n rounds.  Only labels and edges are shuffled, hubs are summed before the exchange, and the
    driver gets one count a round.  Edges may repeat; every round reads them, so they should be a written table.
    ``known`` may hold the components of a part of the edges: labels start from there, so that only what new edges
    join takes rounds.  An empty edge table gives an empty result.
    """
    ends = edges.select("a", "b").where("a <> b")
    both = ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    if known is not None:
        label = label.join(known.withColumnRenamed("component", "before"), "id", "left").select("id", F.least("component", "before").alias("component"))
    label = durable(label, "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        after = durable(step.join(jump, "component").select("id", F.least("component", "beyond").alias("component"), "was"), "labels")
        changed = after.where("component <> was").limit(1).count()
        drop(label)
        label = after
        if not changed:
            return label.select("id", "component")
