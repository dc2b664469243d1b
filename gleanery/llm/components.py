"""Connected components by breadth-first expansion from many seeds at once.

Adjacency is a table that is hash-partitioned by node.  In each level a
pseudo-random part of the nodes are seeds; all of them expand concurrently for a
few rounds, a node keeps the least seed that reaches it, and an edge whose ends
got different seeds becomes an edge of a smaller graph of seeds, in which
colliding seeds are merged the same way.  A path of any length shrinks by a
constant factor in each level, so the number of jobs grows with the logarithm
of the longest path.  Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import scratch

#: One node in so many is a seed.
SEED_SHARE = 3
#: Rounds of expansion in one level.
ROUNDS = 2


def _is_seed(node: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(SEED_SHARE)) == 0


def _contract(arcs: DataFrame, level: int) -> DataFrame:
    """node, label for every node of the arcs (u, v, both directions): the seed that reached it first, or itself."""
    nodes = arcs.select(F.col("u").alias("node")).distinct()
    labels = nodes.withColumn("label", F.when(_is_seed(F.col("node"), level), F.col("node"))).withColumn("born", F.when(F.col("label").isNotNull(), 0))
    for turn in range(1, ROUNDS + 1):
        # the frontier is what the last round labelled; each node without a label takes the least one next to it
        frontier = labels.filter(F.col("born") == turn - 1)
        reached = frontier.join(arcs, F.col("node") == F.col("u")).groupBy("v").agg(F.min("label").alias("near"))
        labels = labels.join(reached, F.col("node") == F.col("v"), "left").select(
            "node", F.coalesce("label", "near").alias("label"), F.coalesce("born", F.when(F.col("near").isNotNull(), turn)).alias("born"),
        )
    # a component part without any seed: each node joins its least neighbour if that is less than itself
    least = arcs.groupBy("u").agg(F.min("v").alias("low"))
    lone = labels.join(least, F.col("node") == F.col("u"))
    return lone.select("node", F.coalesce("label", F.least("node", "low")).alias("label"))


def connected_components(edges: DataFrame, most_levels: int = 100) -> DataFrame:
    """node, component for every node of the edges (u, v); component is the least node of its component.

    Loops and repeated or reversed edges change nothing; an edge with a null
    end is left out; no edges give no rows.
    """
    spark = edges.sparkSession
    clean = edges.select("u", "v").filter("u is not null and v is not null")
    everything = clean.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    kind = everything.schema["node"].dataType.simpleString()
    arcs = clean.filter("u != v").unionByName(clean.filter("u != v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    arcs = scratch.materialize(arcs, "arcs")
    maps: list[DataFrame] = []
    for level in range(most_levels):
        if arcs.isEmpty():
            break
        labels = scratch.materialize(_contract(arcs, level), "labels")
        maps.append(labels)
        one, two = labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        arcs = scratch.materialize(arcs.join(one, "u").join(two, "v").filter("lu != lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct(), "arcs")
    else:
        raise RuntimeError(f"components did not settle in {most_levels} levels")
    if not maps:
        return everything.select("node", F.col("node").alias("component"))
    # follow the seeds down the levels, then name each component by its least node
    final = maps[0].select("node", "label")
    for labels in maps[1:]:
        final = final.join(
            labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left",
        ).select("node", F.coalesce("next", "label").alias("label"))
    final = everything.join(scratch.materialize(final, "roots"), "node", "left").select("node", F.coalesce("label", "node").alias("root"))
    final = scratch.materialize(final, "rooted")
    names = final.groupBy("root").agg(F.min("node").alias("component"))
    return final.join(names, "root").select("node", F.col("component").cast(kind).alias("component"))
