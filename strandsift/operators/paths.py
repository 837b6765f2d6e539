"""Statistics of the maximal paths through the nodes of any directed graph.

A node with one edge in and one out is unary; from a node, a path goes on over unary nodes to the first other node, which
it includes.  The sum of a path counts unary nodes whole and its last node over its number of edges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable


def _ahead(unary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For unary nodes (side, id, weight, next, open): (side, id, tip, hops, mass) with the first node ahead that isn't
    unary, the steps to it and the weights of the unary nodes before it, this one included; and (side, id, size, mass)
    of those on cycles, with the nodes and weights of the cycle.  Both sides go by the same rounds of doubling."""
    first = unary.select("side", "id", F.col("next").alias("tip"), F.lit(1).cast("long").alias("hops"), F.col("weight").cast("double").alias("mass"), "open", F.col("id").alias("label"))
    state = durable(first, "paths")
    found = state.where("not open")
    left = state.where("open").count()
    rounds, more = 0, 64
    while left and rounds < more:
        known = found.unionAll(state.where("open"))
        look = known.select("side", F.col("id").alias("tip"), F.col("tip").alias("t"), F.col("hops").alias("h"), F.col("mass").alias("w"), F.col("open").alias("o"), F.col("label").alias("l"))
        moved = state.where("open").join(look, ["side", "tip"]).select(
            "side", "id", F.col("t").alias("tip"), (F.col("hops") + F.col("h")).alias("hops"), (F.col("mass") + F.col("w")).alias("mass"), F.col("o").alias("open"), F.least("label", "l").alias("label")
        )
        state, before = durable(moved, "paths"), left
        found = found.unionAll(state.where("not open"))
        left = state.where("open").count()
        rounds += 1
        if left == before and more == 64:  # only cycles are left: a window must reach round the longest
            more = rounds + math.ceil(math.log2(max(2, left))) + 1
    circles = state.where("open").select("side", "id", "label").join(unary.select("side", "id", "weight"), ["side", "id"])
    sums = circles.groupBy("side", "label").agg(F.count("*").alias("size"), F.sum("weight").cast("double").alias("mass"))
    return found.select("side", "id", "tip", "hops", "mass"), circles.select("side", "id", "label").join(sums, ["side", "label"])


def path_statistics(nodes: DataFrame, edges: DataFrame, seed: int = 1, loop_nodes: int = 1) -> DataFrame:
    """(id, nodes, total) for every node of ``nodes`` (id, weight) in a graph of ``edges`` (src, dst).

    An isolated node is a path by itself.  A unary node's path goes both ways; on a cycle of unary nodes it is the cycle,
    and where the node is its own neighbour it has ``loop_nodes`` nodes.  Any other node goes to one of its neighbours in
    or out, chosen by a hash of seed and ids, with its own weight over its number of edges.
    """
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("dout"), F.min("dst").alias("next"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("din"), F.min("src").alias("back"))
    full = nodes.select("id", "weight").join(out, "id", "left").join(into, "id", "left").fillna(0, ["dout", "din"])
    full = durable(full.withColumn("unary", (F.col("dout") == 1) & (F.col("din") == 1)).withColumn("share", F.col("weight") / F.greatest(F.lit(1), F.col("dout") + F.col("din"))), "graph")
    flags = full.select(F.col("id").alias("n"), F.col("unary").alias("open"))
    way = lambda i, name: full.where("unary").select(F.lit(i).alias("side"), "id", "weight", F.col(name).alias("next"))
    found, circles = _ahead(way(0, "next").unionAll(way(1, "back")).join(flags.withColumnRenamed("n", "next"), "next"))
    found = durable(found.join(full.select(F.col("id").alias("tip"), F.col("share").alias("end")), "tip").select("side", "id", "hops", "mass", "end"), "reach")
    right, left = (found.where(F.col("side") == i).drop("side") for i in (0, 1))
    circles = circles.where("side = 0")
    weight = full.select("id", "weight", (F.col("next") == F.col("id")).alias("loop"))
    both = right.join(left.select("id", F.col("hops").alias("h2"), F.col("mass").alias("m2"), F.col("end").alias("e2")), "id").join(weight, "id")
    unary = both.select("id", (F.lit(1) + F.col("hops") + F.col("h2")).alias("nodes"), (F.col("mass") + F.col("m2") - F.col("weight") + F.col("end") + F.col("e2")).alias("total"))
    loops = circles.join(weight, "id").select("id", F.when(F.col("loop"), F.lit(loop_nodes)).otherwise(F.col("size")).cast("long").alias("nodes"), F.col("mass").alias("total"))
    alone = full.where("dout = 0 and din = 0").select("id", F.lit(1).cast("long").alias("nodes"), F.col("weight").cast("double").alias("total"))
    rest = full.where("not unary and dout + din > 0").select("id", "share")
    ways = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(0).alias("side")).unionAll(edges.select(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(1).alias("side")))
    pick = F.min(F.struct(F.xxhash64(F.lit(seed), "id", "to", "side").alias("h"), "to", "side")).alias("x")
    chosen = rest.join(ways.groupBy("id").agg(pick), "id").select("id", "share", F.col("x.to").alias("to"), F.col("x.side").alias("side"))
    on = chosen.join(found.withColumnRenamed("id", "to"), ["to", "side"], "left").join(full.select(F.col("id").alias("to"), F.col("share").alias("stop")), "to")
    others = on.select("id", (F.lit(2) + F.coalesce("hops", F.lit(0))).cast("long").alias("nodes"), (F.col("share") + F.coalesce(F.col("mass") + F.col("end"), "stop")).alias("total"))
    return unary.unionAll(loops).unionAll(alone).unionAll(others)
