"""The pN_ queries over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import boundary_split, cross_split, encode, group_splits, leakage, near_duplicates, shared_spans, token_budget


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "p1_found": lambda s, d: token_budget.unusable_counts(
            t(s, d, "chunks_child"), documents=t(s, d, "corpus_docs").select("text", F.col("meta")["lang"].alias("lang")),
        ),
        "p1_token_budget": lambda s, d: token_budget.token_budget(t(s, d, "corpus_docs"), t(s, d, "chunks_child")),
        "p1_records": lambda s, d: token_budget.token_budget(t(s, d, "corpus_docs"), t(s, d, "chunks_child")).select(
            "record_kind", "corpus", "language", "domain", "n_records",
        ),
        "p2_found": lambda s, d: near_duplicates.duplicate_pairs(t(s, d, "corpus_docs"), t(s, d, "chunks_child")),
        "p2_groups": lambda s, d: near_duplicates.duplicate_groups(t(s, d, "corpus_docs"), t(s, d, "chunks_child")),
        "p3_found": lambda s, d: group_splits.broken_records(t(s, d, "evalset"), t(s, d, "doc_moves")),
        "p3_splits": lambda s, d: group_splits.assign_splits(t(s, d, "evalset"), t(s, d, "doc_moves")),
        "p4_found": lambda s, d: boundary_split.faulty_chunks(t(s, d, "corpus_docs"), t(s, d, "chunks_child")),
        "p4_pieces": lambda s, d: boundary_split.split_oversized(
            boundary_split.with_limits(t(s, d, "corpus_docs"), t(s, d, "chunks_child")), keep=("chunk_set_id",),
        ),
        "p4_piece_checks": lambda s, d: boundary_split.piece_checks(boundary_split.with_limits(t(s, d, "corpus_docs"), t(s, d, "chunks_child"))),
        "p5_found": lambda s, d: cross_split.overlapping_questions(t(s, d, "evalset")),
        "p5_report": lambda s, d: cross_split.overlap_report(t(s, d, "evalset")),
        "p6_ids": lambda s, d: encode.encode_documents(t(s, d, "documents")),
        "p6_roundtrip": lambda s, d: encode.decoded_documents(encode.encode_documents(t(s, d, "documents"))).select("doc_id", F.md5("text").alias("digest")),
        "p7_found": lambda s, d: leakage.leaked_pairs(t(s, d, "documents"), t(s, d, "heldout_items")),
        "p7_items": lambda s, d: leakage.leaked_items(t(s, d, "documents"), t(s, d, "heldout_items")),
        "p8_found": lambda s, d: shared_spans.shared_pairs(t(s, d, "documents")),
        "p8_coverage": lambda s, d: shared_spans.shared_coverage(t(s, d, "documents")),
    }
