import importlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gleanery import joins
from gleanery.plans import queries


def missing(name):
    def load(module):
        raise ModuleNotFoundError(f"no module {name}", name=name)

    return load


def test_only_the_absence_of_the_subpackage_passes(monkeypatch):
    for name in ("gleanery.llm", "gleanery.llm.queries"):
        monkeypatch.setattr(importlib, "import_module", missing(name))
        assert __spark_entry__.queries().keys() == queries.queries().keys()
    monkeypatch.setattr(importlib, "import_module", missing("some_library"))
    with pytest.raises(ModuleNotFoundError, match="some_library"):
        __spark_entry__.queries()
    with pytest.raises(ModuleNotFoundError, match="some_library"):
        __spark_entry__.oracle_sql()


def test_every_statement_is_of_a_query():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and len(found) >= len(queries.queries())


def test_sides_are_broadcast_by_their_bytes(spark):
    frame = spark.createDataFrame([(1, "abc", [1, 2, 3], None), (2, None, None, {"k": "v"})], "a int, b string, c array<int>, d map<string,string>")
    assert 100 < joins.byte_size(frame) < 400 and joins.byte_size(frame.limit(0)) == 0
    wide = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("t"))
    assert joins.is_small(wide, 20_000) and not joins.is_small(wide, 9_000)
    plan = lambda limit: joins.keep_matching(spark.range(100).withColumnRenamed("id", "k"), wide, ["k"], "inner", limit)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(20_000) and "SortMergeJoin" in plan(9_000)
