"""Properties of the physical plans that matter at scale."""

import os
import re

import pytest

from gleanery.plans import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(spark, name):
    return queries.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chunk_overlaps", "delivered_chunk_sizes", "parent_assignment", "doc_ids", "query_splits", "evalset_counts", "trace_metrics"])
def test_texts_are_not_read_where_they_are_not_needed(spark, name):
    for columns in re.findall(r"ReadSchema: struct<(.*)", plan(spark, name)):
        assert not re.search(r"\b(text|embed_text|query|answer):", columns)


def test_filters_reach_the_scan(spark):
    assert "EqualTo(label,3)" in plan(spark, "dense_label_topk")
    assert "IsNotNull(text)" in plan(spark, "normalized_texts")


def test_ranking_limits_rows_before_the_shuffle(spark):
    found = plan(spark, "worst_queries")
    assert found.count("WindowGroupLimit") == 2  # a partial one before the exchange and a final one


@pytest.mark.parametrize("name", ["token_counts", "normalized_texts", "document_headings", "fixed_chunks", "previews"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_no_cartesian_product_over_tables(spark, name):
    assert "CartesianProduct" not in plan(spark, name)
