import random

from gleanery.llm import group_splits, labels
from pyspark.sql import functions as F

EVAL = "query_id string, gold_doc_id string, split string, component string"
MOVES = "old_doc_id string, new_doc_id string"


def test_bare_ids_and_labels(spark):
    rows = spark.createDataFrame([("doc:F2E4-0ff9-4a33",), (" ab ",), ("xyz",), (None,), ("api_docs/f2e40ff94a33",)], "x string").select(labels.bare_id(F.col("x")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["f2e40ff94a33", "ab", None, None, "f2e40ff94a33"]
    rows = spark.createDataFrame([(" VALID", "fr_FR", "\u00a0Legal\t"), (None, None, None), ("odd", "xx", ""), ("trn", "JPN", "x")], "s string, l string, d string")
    got = [tuple(r) for r in rows.select(labels.split_name(F.col("s")), labels.language(F.col("l")), labels.domain(F.col("d"))).collect()]
    assert got == [("dev", "fr", "legal"), (None, "und", "unknown"), (None, "und", "unknown"), ("train", "ja", "x")]


def test_broken_records(spark):
    a, b, c, d = (x * 12 for x in "abcd")
    records = [
        ("q1", a, "train", "z"), ("q2", f"doc:{b.upper()}", "dev", "z"), ("q3", c, "train", "z"), ("q4", d, "test", "z"), ("q5", d, "TEST ", "z"), ("q6", None, "dev", "z"), ("q7", a, None, "z"),
        ("q8", a, "no split", "z"), (None, a, "dev", "z"), ("q1", a, "train", "z"), ("q9", "", "dev", "z"),
    ]
    moves = [(a, "e" * 12), ("e" * 12, b), (b, a), (None, c), (a, a), ("zz", c)]
    got = group_splits.broken_records(spark.createDataFrame(records, EVAL), spark.createDataFrame(moves, MOVES))
    assert sorted(r["query_id"] for r in got.collect()) == ["q1", "q2"]
    assert group_splits.broken_records(spark.createDataFrame([], EVAL), spark.createDataFrame([], MOVES)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(3)
    name = lambda i: f"{i:012x}"
    records = [(f"q{i}", name(7) if i % 3 == 0 else name(rnd.randrange(300)), None, "z") for i in range(3000)] + [("lone", None, None, "z")]
    moves = [(name(i), name(i + 1)) for i in range(0, 300, 5)]
    got = {r["query_id"]: (r["group_id"], r["split"]) for r in group_splits.assign_splits(spark.createDataFrame(records, EVAL), spark.createDataFrame(moves, MOVES)).collect()}
    assert len(got) == 3001
    groups = {}
    for group, split in got.values():
        groups.setdefault(group, set()).add(split)
    assert all(len(s) == 1 for s in groups.values())
    share = {s: sum(x == s for _, x in got.values()) / 3001 for s in ("train", "dev", "test")}
    assert abs(share["train"] - 0.6) < 0.03 and abs(share["dev"] - 0.2) < 0.03 and abs(share["test"] - 0.2) < 0.03
    assert group_splits.assign_splits(spark.createDataFrame([], EVAL), spark.createDataFrame([], MOVES)).count() == 0
