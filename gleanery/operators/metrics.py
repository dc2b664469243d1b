"""Scores of ranked results against gold chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Depths at which recall is told.
RECALL_DEPTHS = (1, 3, 5, 10)
#: Numbers that a resampling draws at once: 32 MB.
DRAWN = 4_000_000


def hit_ranks(retrieved: Column, gold: Column) -> Column:
    """1-based ranks of the retrieved ids that are gold."""
    return F.filter(F.transform(retrieved, lambda c, i: F.when(F.array_contains(gold, c), i + 1)), lambda x: x.isNotNull())


def recall_at(ranks: Column, depth: int) -> Column:
    """1.0 if any hit is among the first `depth`, else 0.0."""
    return F.coalesce((F.array_min(ranks) <= depth).cast("double"), F.lit(0.0))


def reciprocal_rank(ranks: Column) -> Column:
    return F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0))


def _gain(positions: Column) -> Column:
    return F.aggregate(positions, F.lit(0.0), lambda s, p: s + F.lit(1.0) / F.log2(p + F.lit(1.0)))


def ndcg_at(ranks: Column, n_gold: Column, depth: int) -> Column:
    """Binary gain by log2(rank + 1), over that of the best possible order; null without gold."""
    best = F.when(n_gold > 0, _gain(F.sequence(F.lit(1), F.least(n_gold, F.lit(depth)))))
    return _gain(F.filter(ranks, lambda p: p <= depth)) / best


def traces(queries: DataFrame, hits: DataFrame, gold: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """One row per query with its ranked ids, gold ids and metrics; a query without gold chunks is excluded and has no metric.

    recall@d is 1 if any gold chunk is among the first d; ndcg uses binary gain over
    min(10, k) ranks; chunk_efficiency is the tokens of the first k chunks, null on a
    miss; all_spans_hit is for queries of more than one span.  `gold` is the
    result of resolve_gold.
    """
    size = chunks.groupBy("chunk_id").agg(F.max("token_count").alias("tokens"))
    best = hits.filter(F.col("rank") <= k).join(size, "chunk_id", "left")
    lists = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score", "tokens"))).alias("r"))
    spans = gold.groupBy("query_id", "span_no").agg(F.collect_set("chunk_id").alias("ids")).groupBy("query_id").agg(F.collect_list("ids").alias("span_gold"))
    wanted = queries.select("query_id", "query", F.size("gold_char_spans").alias("n_spans")).join(lists, "query_id", "left").join(spans, "query_id", "left")
    none = F.array().cast("array<string>")
    rows = wanted.select(
        "query_id", "query", "n_spans", "span_gold",
        F.coalesce(F.transform("r", lambda x: x["chunk_id"]), none).alias("retrieved_chunk_ids"),
        F.coalesce(F.transform("r", lambda x: x["score"]), F.array().cast("array<double>")).alias("retrieved_scores"),
        F.coalesce(F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["tokens"], F.lit(0))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sort_array(F.array_distinct(F.flatten("span_gold"))), none).alias("gold_chunk_ids"),
    )
    excluded = F.size("gold_chunk_ids") == 0
    rows = rows.withColumn("ranks", hit_ranks(F.col("retrieved_chunk_ids"), F.col("gold_chunk_ids")))
    ranks, first = F.col("ranks"), F.array_min("ranks")
    scored = lambda c: F.when(~excluded, c)
    out = [scored(recall_at(ranks, d)).alias(f"recall_{d}") for d in RECALL_DEPTHS if d <= k]
    top = F.slice("retrieved_chunk_ids", 1, k)
    return rows.select(
        "query_id", "query", "retrieved_chunk_ids", "retrieved_scores", F.when(
            ~excluded, F.col("gold_chunk_ids"),
        ).otherwise(none).alias("gold_chunk_ids"), first.alias("first_hit_rank"), *out,
        scored(reciprocal_rank(ranks)).alias("mrr"),
        scored(ndcg_at(ranks, F.size("gold_chunk_ids"), min(10, k))).alias("ndcg_10"),
        scored(F.when(first <= k, F.col("tokens").cast("double"))).alias("chunk_efficiency"),
        scored(F.when(F.col("n_spans") > 1, ((F.size("span_gold") == F.col("n_spans")) & F.forall("span_gold", lambda ids: F.arrays_overlap(top, ids))).cast("double"))).alias("all_spans_hit"),
        excluded.alias("excluded"), F.when(excluded, "gold resolved to zero chunks for this chunk set").alias("exclusion_reason"),
    )


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of all metrics over the queries that are not excluded, and how many there were."""
    names = [c for c in rows.columns if c.startswith("recall_") or c in ("mrr", "ndcg_10", "chunk_efficiency", "all_spans_hit")]
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("queries"), F.sum(F.col("excluded").cast("int")).alias("excluded"),
        *(F.round(F.avg(c), 6).alias(c) for c in names),
    )


def latency(rows: DataFrame, by: list[str], column: str = "latency_ms") -> DataFrame:
    """latency_p50, latency_p95 by exact interpolation; nulls are left out."""
    return rows.groupBy(*by).agg(F.percentile(column, F.lit(0.5)).alias("latency_p50"), F.percentile(column, F.lit(0.95)).alias("latency_p95"))


def bootstrap_interval(values: np.ndarray, resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean; (0, 0) of nothing, the point itself of one value."""
    values = np.asarray(values, float)
    if len(values) < 2:
        return (0.0, 0.0) if not len(values) else (float(values[0]), float(values[0]))
    draw, means = np.random.default_rng(seed), np.empty(resamples)
    step = max(DRAWN // len(values), 1)  # drawing in blocks gives the same numbers as drawing all at once
    for at in range(0, resamples, step):
        size = (min(step, resamples - at), len(values))
        means[at : at + step] = values[draw.integers(0, len(values), size=size)].mean(axis=1)
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def bootstrap(rows: DataFrame, by: list[str], value: str, order: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """by..., mean, low, high, n: the interval of each group, its values taken in the given order.

    A group is the queries of one experiment cell, which is a stated set.
    """
    kinds = dict(rows.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values(order)[value].dropna().to_numpy(float)
        low, high = bootstrap_interval(values, resamples, alpha, seed)
        return pd.DataFrame(
            [[*(frame[c].iloc[0] for c in by), float(values.mean()) if len(values) else 0.0, low, high, len(values)]],
            columns=[*by, "mean", "low", "high", "n"],
        )

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", mean double, low double, high double, n long"
    return rows.select(*by, order, value).groupBy(*by).applyInPandas(run, schema)


def worst(rows: DataFrame, n: int) -> DataFrame:
    """The n worst queries: misses first, then by recall at 5, excluded ones last; ties by query_id."""
    return rows.orderBy("excluded", F.col("first_hit_rank").isNotNull(), F.coalesce("recall_5", F.lit(0.0)), "query_id").limit(n)
