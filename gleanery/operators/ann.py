"""Approximate neighbours by inverted lists of vectors.

Centroids are fitted on a bounded sample; every vector is filed in the list of
its nearest centroid, and a query is compared with the vectors of the nearest
lists only.  Searching all lists gives the exact result of `retrieval.dense`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import retrieval

#: Vectors that the centroids are fitted on, at most about: those whose ids have the lowest hashes.
SAMPLE_ROWS = 20_000
#: Rounds of moving the centroids.
ROUNDS = 12


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1.0, size)


def fit_centroids(store: DataFrame, lists: int, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> np.ndarray:
    """Up to `lists` unit vectors around which the sampled vectors of the store (chunk_id, embedding) lie."""
    rows = store.select("chunk_id", "embedding").filter("embedding is not null")
    total = rows.count()
    if not total:
        return np.zeros((0, 0))
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40))
    sample = rows.filter(place < int(min(1.0, sample_rows / total) * (1 << 40))).orderBy(place, "chunk_id").limit(2 * sample_rows)
    found = sample.select("embedding").collect() or rows.select("embedding").limit(lists).collect()
    points = _unit(np.array([r["embedding"] for r in found], float))
    centers = points[np.random.default_rng(seed).permutation(len(points))[:lists]]
    for _ in range(ROUNDS):
        nearest = np.argmax(points @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, points)
        held = np.bincount(nearest, minlength=len(centers)) > 0
        centers = _unit(np.where(held[:, None], sums, centers))
    return centers


def filed(store: DataFrame, centroids: np.ndarray) -> DataFrame:
    """chunk_id, embedding, list: every vector of the store with the list it belongs to; write it partitioned by list for large stores."""
    kinds = {f.name: f.dataType.simpleString() for f in store.schema.fields}
    shared = store.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = _unit(np.stack(frame["embedding"].to_numpy()).astype(float))
                yield frame.assign(list=np.argmax(rows @ shared.value.T, axis=1).astype(np.int32))

    return store.select("chunk_id", "embedding").filter("embedding is not null").mapInPandas(
        run, f"chunk_id {kinds['chunk_id']}, embedding {kinds['embedding']}, list int",
    )


def search(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probes: int, retriever: str = "dense", digits: int = 6) -> DataFrame:
    """The k best of the `probes` nearest lists for each query (query_id, vector); scores and ties as in `retrieval.dense`.

    The queries are the stated side and go to the workers in blocks; each batch
    of the index compares a list with those queries alone that look into it.
    """
    spark = index.sparkSession
    kinds = index.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double"
    found = spark.createDataFrame([], schema)

    def block_of(asked: list) -> DataFrame:
        matrix = _unit(np.array([v for _, v in asked], float))
        near = np.argsort(-(matrix @ centroids.T), axis=1, kind="stable")[:, :probes]
        askers = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast(([q for q, _ in asked], matrix, askers))

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, vectors, lookers = shared.value
            best: list[pd.DataFrame] = []
            for frame in frames:
                for number, part in frame.sort_values("chunk_id").groupby("list"):
                    who = lookers.get(int(number))
                    if who is None:
                        continue
                    rows = _unit(np.stack(part["embedding"].to_numpy()).astype(float))
                    ids = part["chunk_id"].to_numpy()
                    for at in range(0, len(rows), retrieval.CHUNK_BLOCK):
                        scores = np.round(vectors[who] @ rows[at : at + retrieval.CHUNK_BLOCK].T, digits) + 0.0
                        some = retrieval._block_best(scores, ids[at : at + retrieval.CHUNK_BLOCK], k)
                        best.append(some.assign(q=who[some["q"].to_numpy()]))
                if len(best) > 64:
                    best = [retrieval._best(best, k)]
            if best:
                out = retrieval._best(best, k)
                yield pd.DataFrame({"query_id": [names[i] for i in out["q"]], "chunk_id": out["chunk_id"].to_numpy(), "score": out["score"].to_numpy()})

        return index.filter(F.col("list").isin(list(askers))).select("chunk_id", "embedding", "list").mapInPandas(run, schema)

    block: list = []
    for row in queries.select("query_id", "vector").filter("vector is not null").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == retrieval.QUERY_BLOCK:
            found, block = found.unionByName(block_of(block)), []
    if block and len(centroids):
        found = found.unionByName(block_of(block))
    return retrieval.ranked(found, k, retriever)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: the share of the exact hits (query_id, chunk_id) that the approximate ones hold."""
    both = exact.select("query_id", "chunk_id").join(approximate.select("query_id", "chunk_id").withColumn("got", F.lit(1)), ["query_id", "chunk_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.count("got") / F.greatest(F.count("*"), F.lit(1))).alias("recall"))
