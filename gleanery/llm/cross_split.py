"""Evaluation questions that also stand, exactly or almost, in the training split (problem 5).

A question is made canonical by folding case, marks, punctuation and white
space to its set of words; order and repetition don't matter.  First the hashes
of the canonical questions of the evaluation splits are joined with those of the
training split: these are the exact repetitions.  Almost equal questions have
other hashes; for them the hashes of the rarest words of each canonical
question are joined, as many of them as two sets of the threshold must share
one of, and exact sets decide.  Both stages work on one row for each canonical
question, so copies cost nothing until pairs are written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import labels, similarity
from gleanery.llm.similarity import Matches, Measure

#: Sets of single words with a Jaccard similarity of at least 0.6; see TESTDATA.md.
PROJECT_MEASURE = Measure(run_length=1, threshold=0.6, min_words=1, cross_only=True, overlaps=1)


def question_records(evalset: DataFrame) -> DataFrame:
    """Questions with an id, a text and a split; role 1 is train, role 2 dev or test."""
    split = labels.split_name(F.col("split"))
    return evalset.select(
        F.lit(0).alias("part"), F.col("query_id").alias("record"), F.col("query_id").alias("owner"),
        F.when(split == "train", 1).when(split.isNotNull(), 2).alias("role"), F.col("query").alias("text"),
    ).filter("record is not null and role is not null and text is not null")


def _sides(found: Matches) -> tuple[DataFrame, DataFrame]:
    """(record, cls) of the evaluation questions and of the training questions."""
    return tuple(found.members.filter(F.col("role") == role).select("record", "cls").distinct() for role in (2, 1))


def _near(found: Matches) -> DataFrame:
    """cls, other: almost equal canonical questions, in both directions."""
    return found.links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(found.links.select(F.col("b").alias("cls"), F.col("a").alias("other")))


def overlapping_questions(evalset: DataFrame, measure: Measure = PROJECT_MEASURE) -> DataFrame:
    """query_id_a < query_id_b: every pair of a training and an evaluation question that overlap.

    Null queries, ids and splits, unknown split names and questions without a
    word have no pair; rows sent again are one record, and a record that was
    sent with two different splits stands on both sides.
    """
    found = similarity.similar(question_records(evalset), measure)
    asked, trained = _sides(found)
    trained = trained.withColumnRenamed("record", "known")
    same = asked.join(trained, "cls").select("record", "known")
    almost = asked.join(_near(found), "cls").join(trained.withColumnRenamed("cls", "other"), "other").select("record", "known")
    return same.unionByName(almost).filter("record != known").select(
        F.least("record", "known").alias("query_id_a"), F.greatest("record", "known").alias("query_id_b"),
    ).distinct()


def overlap_report(evalset: DataFrame, measure: Measure = PROJECT_MEASURE) -> DataFrame:
    """split, corpus, n_questions, n_exact, n_leaked: evaluation questions, those whose canonical hash stands in train, and those that stand there exactly or almost.

    Questions are counted on canonical hashes, so copies are never paired.
    """
    found = similarity.similar(question_records(evalset), measure)
    asked, trained = _sides(found)
    trained = trained.select("cls").distinct()
    almost = _near(found).join(trained.withColumnRenamed("cls", "other"), "other", "left_semi").select("cls")
    hit = trained.withColumn("same", F.lit(1)).unionByName(almost.distinct().withColumn("same", F.lit(0))).groupBy("cls").agg(F.max("same").alias("same"))
    marked = asked.join(hit, "cls").groupBy(F.col("record").alias("query_id")).agg(F.max("same").alias("same"))
    questions = evalset.select(
        "query_id", labels.split_name(F.col("split")).alias("split"), "corpus",
    ).filter("query_id is not null and split in ('dev', 'test')").distinct()
    return questions.join(marked, "query_id", "left").groupBy("split", "corpus").agg(
        F.count("*").alias("n_questions"), F.coalesce(F.sum("same"), F.lit(0)).alias("n_exact"), F.count("same").alias("n_leaked"),
    )
