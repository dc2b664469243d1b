"""Train, dev and test splits that keep related records together (problem 3).

Records belong together when their bare gold ids are equal or linked by moves.
Moves make a graph of ids whose components come from the frontier expansion of
`components`; records are only counted per id before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import joins, scratch
from gleanery.llm import components, labels

#: Shares of train, dev and test.
SHARES = (("train", 0.6), ("dev", 0.2), ("test", 0.2))
#: Slices of the hash order; their sums are all that is put in sequence at once.
SLICES = 4096
#: A component of more than this share of all records is placed before the others, so at most 100 are.
HEAVY = 0.01


def gold_components(moves: DataFrame) -> DataFrame:
    """node, component over bare ids; a move without a usable id on both sides links nothing."""
    edges = moves.select(labels.bare_id(F.col("old_doc_id")).alias("u"), labels.bare_id(F.col("new_doc_id")).alias("v"))
    return scratch.materialize(components.connected_components(edges), "gold-components")


def _group_of(ids: DataFrame, found: DataFrame) -> DataFrame:
    """`ids` (with bare) and the group of each: its component, or the id itself."""
    return ids.join(found.select(F.col("node").alias("bare"), "component"), "bare", "left").withColumn("group", F.coalesce("component", "bare")).drop("component")


def broken_records(evalset: DataFrame, moves: DataFrame) -> DataFrame:
    """query_id of records with gold id and split whose group has more than one split.

    Spellings of a split count as that split; records with a null gold id, no
    hex digit in it, a null or an unknown split belong to no group; rows sent
    again are one record.
    """
    records = evalset.select(
        "query_id", labels.bare_id(F.col("gold_doc_id")).alias("bare"), labels.split_name(F.col("split")).alias("split"),
    ).filter("bare is not null and split is not null")
    ids = records.groupBy("bare").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    grouped = scratch.materialize(_group_of(ids, gold_components(moves)), "gold-groups")
    mixed = grouped.groupBy("group").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("group")
    bad = scratch.materialize(grouped.join(mixed, "group", "left_semi").select("bare"), "gold-mixed")
    return joins.keep_matching(records, bad, ["bare"]).select("query_id").filter("query_id is not null").distinct()


def assign_splits(evalset: DataFrame, moves: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: str = "") -> DataFrame:
    """query_id, group_id, split: a split for every record such that a group shares one.

    Groups are taken in the order of a hash of their id and fill the splits one
    after the other up to their shares of all records.  Groups of more than one
    percent of the records come first, each into the split that lacks most.
    A record without a usable gold id is a group of its own.
    """
    records = evalset.select("query_id", labels.bare_id(F.col("gold_doc_id")).alias("bare")).filter("query_id is not null").distinct()
    records = records.withColumn("bare", F.coalesce("bare", F.concat(F.lit("query:"), "query_id")))
    ids = records.groupBy("bare").agg(F.count("*").alias("n"))
    grouped = scratch.materialize(_group_of(ids, gold_components(moves)), "split-groups")
    sizes = scratch.materialize(
        grouped.groupBy("group").agg(F.sum("n").alias("n")).withColumn(
            "place", F.conv(F.substring(F.md5(F.concat(F.lit(seed), "group")), 1, 10), 16, 10).cast("long"),
        ),
        "split-sizes",
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    room = {name: share * total for name, share in shares}
    heavy: dict[str, str] = {}
    for row in sizes.filter(F.col("n") > HEAVY * total).orderBy(F.desc("n"), "place", "group").collect():  # fewer than 1 / HEAVY rows
        name = max(room, key=lambda x: (room[x], x))
        heavy[row["group"]] = name
        room[name] -= row["n"]
    rest = sizes.filter(~F.col("group").isin(list(heavy))) if heavy else sizes
    width = (1 << 40) // SLICES
    rest = rest.withColumn("slice", F.floor(F.col("place") / width))
    before, running = {}, 0
    for row in rest.groupBy("slice").agg(F.sum("n").alias("n")).orderBy("slice").collect():  # at most SLICES rows
        before[row["slice"]] = running
        running += row["n"]
    begins = sizes.sparkSession.createDataFrame([(int(k), int(v)) for k, v in before.items()] or [(0, 0)], "slice long, before long")
    ahead = F.sum("n").over(_slice_window()) - F.col("n") + F.col("before")
    placed = rest.join(F.broadcast(begins), "slice").select("group", (ahead + F.col("n") / 2).alias("middle"))
    left = {k: max(v, 0.0) for k, v in room.items()}
    scale = running / (sum(left.values()) or 1)
    edges, at = [], 0.0
    for name, _ in shares:
        at += left[name] * scale
        edges.append((name, at))
    choice = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        choice = F.when(F.col("middle") < edge, F.lit(name)).otherwise(choice)
    light = placed.select("group", choice.alias("split"))
    if heavy:
        light = light.unionByName(sizes.sparkSession.createDataFrame(list(heavy.items()), "group string, split string"))
    chosen = grouped.join(light, "group").select("bare", "group", "split")
    return records.join(chosen, "bare").select("query_id", F.col("group").alias("group_id"), "split")


def _slice_window():
    from pyspark.sql import Window

    return Window.partitionBy("slice").orderBy("place", "group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
