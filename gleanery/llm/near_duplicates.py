"""Documents and child chunks that are nearly the same, and the groups they form (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import scratch
from gleanery.llm import components, similarity
from gleanery.llm.similarity import Matches, Measure

#: The measure that TESTDATA.md states for this project's documents and chunks.
PROJECT_MEASURE = Measure(run_length=3, threshold=0.55, min_words=10)
KINDS = ("child", "doc")


def records_of(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Child chunks (part 0, owned by their document) and documents (part 1) as records; rows without an id are left out."""
    child = chunks.select(F.lit(0).alias("part"), F.col("chunk_id").alias("record"), F.col("doc_id").alias("owner"), F.lit(3).alias("role"), "text")
    doc = docs.select(F.lit(1).alias("part"), F.col("doc_id").alias("record"), F.col("doc_id").alias("owner"), F.lit(3).alias("role"), "text")
    return child.unionByName(doc).filter("record is not null")


def near_duplicates(docs: DataFrame, chunks: DataFrame, measure: Measure = PROJECT_MEASURE) -> Matches:
    """Links between classes of equal texts, and the members of each class.

    Null texts and texts under the measure's least number of words have no
    match; rows sent again are one record; a chunk with a null document is
    compared with every other chunk.
    """
    return similarity.similar(records_of(docs, chunks), measure)


def duplicate_pairs(docs: DataFrame, chunks: DataFrame, measure: Measure = PROJECT_MEASURE) -> DataFrame:
    """record_kind, id_a, id_b: every pair of similar records of different documents, copies written out."""
    pairs = similarity.record_pairs(near_duplicates(docs, chunks, measure), other_owner=True)
    kind = F.when(F.col("part") == 0, KINDS[0]).otherwise(KINDS[1])
    return pairs.select(kind.alias("record_kind"), F.col("record_a").alias("id_a"), F.col("record_b").alias("id_b"))


def duplicate_groups(docs: DataFrame, chunks: DataFrame, measure: Measure = PROJECT_MEASURE) -> DataFrame:
    """record_kind, record_id, class_id, n_links, group_id: one row per record that has enough words.

    class_id is the least record_id of the records with an equal set, n_links
    counts the linked other classes, and group_id is the least record_id of the
    component of classes joined by links.
    """
    found = near_duplicates(docs, chunks, measure)
    both = found.links.select("a", "b").unionByName(found.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = both.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("n_links"))
    labels = components.connected_components(found.links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "cls")
    names = found.members.groupBy("cls").agg(F.min("record").alias("class_id"))
    named = names.join(degrees, "cls", "left").join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = scratch.materialize(named, "similar-classes-named")
    groups = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    # a group is as large as the data makes it, but a class has one row here; names go to classes before they go to records
    classes = scratch.materialize(
        named.join(groups, "component").select("cls", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id"),
        "similar-groups",
    )
    kind = F.when(F.col("part") == 0, KINDS[0]).otherwise(KINDS[1])
    return found.members.select("part", "record", "cls").distinct().join(classes, "cls").select(
        kind.alias("record_kind"), F.col("record").alias("record_id"), "class_id", "n_links", "group_id",
    )
