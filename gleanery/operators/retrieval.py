"""Retrieval: ranked chunks for a whole table of queries at once.

Every retriever gives query_id, chunk_id, score, rank and retriever; ranks are
1-based and all ties have a stated order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery import joins, scratch
from gleanery.functions import vectors
from gleanery.functions.text import lexical_terms


#: Queries in one block of a search, and chunks scored at once: bounds of a worker's score matrix (32 MB).
QUERY_BLOCK, CHUNK_BLOCK = 4096, 1024
#: Queries of a block that ask for a term from which on the term is common.
COMMON = 24


def ranked(scores: DataFrame, k: int, retriever: str, *ties: Column) -> DataFrame:
    """The best k rows of each query, numbered again."""
    order = [F.col("score").desc(), *(ties or (F.col("chunk_id"),))]
    top = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return top.select("query_id", "chunk_id", "score", "rank", F.lit(retriever).alias("retriever"))


# --- lexical ---


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf, dl: one row for each term of each chunk; write it once for each chunk set."""
    words = chunks.select("chunk_id", lexical_terms(F.col("text")).alias("w"))
    exploded = words.select("chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    return exploded.groupBy("chunk_id", "term", "dl").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf", "dl")


def lengths(chunks: DataFrame) -> DataFrame:
    """n, avgdl: number of chunks and their mean length in terms, empty ones too."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(lexical_terms(F.col("text"))).cast("double")).alias("avgdl"))


def idf_of(frequencies: DataFrame, totals: DataFrame) -> DataFrame:
    """term, idf of (term, df): ln(N - df + 0.5) - ln(df + 0.5); a negative one becomes a quarter of the mean over all terms."""
    df = frequencies.crossJoin(F.broadcast(totals.select("n")))  # one row
    raw = df.select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((F.avg("raw") * 0.25).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, retriever: str = "bm25") -> DataFrame:
    """Okapi BM25 of each query (query_id, query) over the texts of chunks (chunk_id, text).

    Repeated query terms count repeatedly; scores of 0 fill a list up to k; ties
    go by chunk_id.  Document frequencies and lengths are counted over all
    chunks first.  The queries are the stated side: they go to the workers in
    blocks of bounded size with the weights of their terms, every partition of
    chunks keeps its own k best of each query, and only these are shuffled.
    """
    spark = chunks.sparkSession
    # terms are found once; frequencies, lengths and each block of queries read the written lists
    terms = chunks.filter("chunk_id is not null").select("chunk_id", lexical_terms(F.col("text")).alias("terms"))
    rows = scratch.materialize(scratch.spread(terms), "bm25-terms")
    measured = rows.select("chunk_id", F.size("terms").alias("dl"), F.explode_outer(F.array_distinct("terms")).alias("term"))
    frequencies = scratch.materialize(measured.filter("term is not null").groupBy("term").agg(F.count("*").alias("df")), "bm25-df")
    totals = rows.agg(F.count("*").alias("n"), F.avg(F.greatest(F.size("terms"), F.lit(0)).cast("double")).alias("avgdl")).first()
    asked = queries.select("query_id", F.coalesce(lexical_terms(F.col("query")), F.array().cast("array<string>")).alias("terms"))
    weights = idf_of(frequencies, spark.range(1, numPartitions=1).select(F.lit(totals["n"]).alias("n")))
    wanted = joins.keep_matching(weights, asked.select(F.explode("terms").alias("term")).distinct(), ["term"])
    kinds = rows.schema["chunk_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
    idf = {r["term"]: r["idf"] for r in wanted.toLocalIterator()}  # terms of the stated queries only

    def search(block: list) -> DataFrame:
        words = sorted({t for _, terms in block for t in terms} & idf.keys())
        number = {t: i for i, t in enumerate(words)}
        askers: list[dict[int, int]] = [{} for _ in words]
        for q, (_, terms) in enumerate(block):
            for t in terms:
                if t in number:
                    askers[number[t]][q] = askers[number[t]].get(q, 0) + 1
        lists = [(np.fromiter(a, np.int64, len(a)), np.fromiter(a.values(), float, len(a))) for a in askers]
        shared = spark.sparkContext.broadcast(([q for q, _ in block], words, np.array([idf[t] for t in words]), lists))
        mean = totals["avgdl"] or 1.0

        def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vocabulary, factor, by_term = shared.value
            known = pa.array(vocabulary, pa.string())
            # terms that many queries ask for go through one matrix product, the others through their own few places
            common = np.flatnonzero(np.array([len(who) >= COMMON for who, _ in by_term], bool))
            column = np.full(len(vocabulary), -1)
            column[common] = np.arange(len(common))
            asked_common = np.zeros((len(names), len(common)))
            for j, t in enumerate(common.tolist()):
                asked_common[by_term[t][0], j] = by_term[t][1]
            best = Best(k)
            for whole in stream:
                whole = whole.take(pc.sort_indices(whole.column(0)))
                for at in range(0, whole.num_rows, CHUNK_BLOCK):
                    part = whole.slice(at, CHUNK_BLOCK)
                    lists_ = part.column(1)
                    sizes = np.nan_to_num(pc.list_value_length(lists_).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
                    term = pc.fill_null(pc.index_in(pc.list_flatten(lists_), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    owner = np.repeat(np.arange(part.num_rows), sizes)[term >= 0]
                    pairs, tf = np.unique(term[term >= 0] * part.num_rows + owner, return_counts=True)
                    term, owner = pairs // part.num_rows, pairs % part.num_rows
                    weight = factor[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[owner] / mean))
                    many = column[term] >= 0
                    weights = np.zeros((len(common), part.num_rows))
                    weights[column[term[many]], owner[many]] = weight[many]
                    scores = asked_common @ weights
                    term, owner, weight = term[~many], owner[~many], weight[~many]
                    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else []
                    for x, y in zip(first, [*first[1:], len(term)]):
                        who, often = by_term[term[x]]
                        scores[np.ix_(who, owner[x:y])] += np.outer(often, weight[x:y])
                    best.add(np.round(scores, 6), part.column(0).to_numpy(zero_copy_only=False))
            if best.parts:
                out = best.rows()
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"query_id": [names[i] for i in out["q"]], "chunk_id": out["chunk_id"].to_numpy(), "score": out["score"].to_numpy()}),
                    preserve_index=False,
                )

        return rows.mapInArrow(run, found.schema)

    block: list = []
    for row in asked.toLocalIterator():
        block.append((row["query_id"], row["terms"]))
        if len(block) == QUERY_BLOCK:
            found, block = found.unionByName(search(block)), []
    if block:
        found = found.unionByName(search(block))
    return ranked(found, k, retriever)


def bm25_indexed(queries: DataFrame, index: DataFrame, totals: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, retriever: str = "bm25") -> DataFrame:
    """BM25 by joining a written `postings` table on the queries' terms: for few queries over a large index.

    `totals` is the result of `lengths`.  Only chunks that share a term are listed.
    """
    asked = queries.select("query_id", F.explode(lexical_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weights = idf_of(index.groupBy("term").agg(F.count("*").alias("df")), totals)
    hits = index.join(asked, "term").join(weights, "term").crossJoin(F.broadcast(totals.select("avgdl")))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("qtf")
    return ranked(hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight), 6).alias("score")), k, retriever)


# --- dense ---


def dense(queries: DataFrame, store: DataFrame, k: int, retriever: str = "dense", digits: int = 6, block: int = 4096) -> DataFrame:
    """Exact cosine neighbours: queries (query_id, vector) against the store (chunk_id, embedding).

    The queries are the small, stated side: they go to the workers in blocks of
    at most `block` vectors, each partition of the store keeps its own k best
    of each query by matrix products, and only these are ranked together.
    Scores are rounded before ranking; ties go by chunk_id.
    """
    spark = store.sparkSession
    kinds = store.select("chunk_id").schema["chunk_id"].dataType.simpleString(), queries.select("query_id").schema["query_id"].dataType.simpleString()
    found: DataFrame | None = None
    asked: list = []

    def flush() -> None:
        nonlocal found, asked
        shared = spark.sparkContext.broadcast(([r[0] for r in asked], np.array([r[1] for r in asked], float)))

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            best = Best(k)
            for frame in frames:
                frame = frame.dropna().sort_values("chunk_id")
                if frame.empty:
                    continue
                rows = np.stack(frame["embedding"].to_numpy()).astype(float)
                size = np.linalg.norm(rows, axis=1, keepdims=True)
                rows /= np.where(size == 0, 1, size)
                ids = frame["chunk_id"].to_numpy()
                for at in range(0, len(rows), CHUNK_BLOCK):
                    scores = np.round(matrix @ rows[at : at + CHUNK_BLOCK].T, digits) + 0.0
                    best.add(scores, ids[at : at + CHUNK_BLOCK])
            if best.parts:
                out = best.rows()
                yield pd.DataFrame({"query_id": [names[i] for i in out["q"]], "chunk_id": out["chunk_id"].to_numpy(), "score": out["score"].to_numpy()})

        part = store.select("chunk_id", "embedding").mapInPandas(run, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
        found = part if found is None else found.unionByName(part)
        asked = []

    for row in queries.select("query_id", "vector").filter("vector is not null").toLocalIterator():
        asked.append((row[0], row[1]))
        if len(asked) == block:
            flush()
    if asked or found is None:
        if not asked:
            return spark.createDataFrame([], f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double, rank int, retriever string")
        flush()
    return ranked(found, k, retriever)


def _block_best(scores: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best columns of each row of a score matrix, ties by id; the ids are in order."""
    if scores.shape[1] > k:  # what is above the k-th best score, and of what equals it as many as are left, by id
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        pick, level = scores > least, scores == least
        level &= np.cumsum(level, axis=1, dtype=np.int16 if scores.shape[1] < 1 << 15 else np.int32) <= k - pick.sum(axis=1)[:, None]
        columns = np.nonzero(pick | level)[1].reshape(len(scores), k)
        best = np.argsort(-np.take_along_axis(scores, columns, 1), axis=1, kind="stable")
        top = np.take_along_axis(columns, best, 1)
    else:
        top = np.argsort(-scores, axis=1, kind="stable")
    return pd.DataFrame({"q": np.repeat(np.arange(len(scores)), top.shape[1]), "chunk_id": ids[top.ravel()], "score": np.take_along_axis(scores, top, 1).ravel()})


class Best:
    """The k best of each row over score matrices that come one after another.

    Once a row has k entries, only scores above its last entry, or equal to it
    with a lesser id, are looked at further.
    """

    def __init__(self, k: int):
        self.k, self.parts, self.pending = k, [], 0
        self.least: np.ndarray | None = None
        self.last: np.ndarray | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all rows (queries) against columns whose ids are in order."""
        if self.least is None:
            part = _block_best(scores, ids, self.k)
        else:
            lesser = np.searchsorted(ids, self.last)
            mask = scores == self.least[:, None]
            mask &= np.arange(len(ids)) < lesser[:, None]
            mask |= scores > self.least[:, None]
            q, c = np.nonzero(mask)
            part = pd.DataFrame({"q": q, "chunk_id": ids[c], "score": scores[q, c]})
        self.parts.append(part)
        self.pending += len(part)
        if self.least is None or self.pending > 4 * self.k * len(scores):
            out = self.rows()
            sizes = np.bincount(out["q"], minlength=len(scores))
            if sizes.min() == self.k:
                ends = out.iloc[np.cumsum(sizes) - 1]
                self.least, self.last = ends["score"].to_numpy(), ends["chunk_id"].to_numpy()

    def rows(self) -> pd.DataFrame:
        """q, chunk_id, score of the best so far, in order."""
        self.parts, self.pending = [_best(self.parts, self.k)] if self.parts else [], 0
        return self.parts[0] if self.parts else pd.DataFrame({"q": [], "chunk_id": [], "score": []})


def _best(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    every = pd.concat(parts).sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return every.groupby("q", sort=False).head(k)


def embed_queries(queries: DataFrame, embedder: str = "hash", params: dict | None = None) -> DataFrame:
    return queries.select("query_id", vectors.embedding(F.col("query"), embedder, params, query=True).alias("vector"))


# --- composed ---


def fuse(lists: dict[str, DataFrame], k: int, k_rrf: int = 60, weights: dict[str, float] | None = None, retriever: str = "hybrid") -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k_rrf + rank) over the lists that hold a chunk. Ties go by chunk_id."""
    terms = [rows.select("query_id", "chunk_id", (F.lit(float((weights or {}).get(name, 1.0))) / (F.col("rank") + k_rrf)).alias("term")) for name, rows in lists.items()]
    every = terms[0]
    for more in terms[1:]:
        every = every.unionByName(more)
    return ranked(every.groupBy("query_id", "chunk_id").agg(F.round(F.sum("term"), 9).alias("score")), k, retriever)


def to_parents(children: DataFrame, chunks: DataFrame, k: int, retriever: str = "parent_doc", parents: DataFrame | None = None) -> DataFrame:
    """Ranked children (fetch k times a fan-out of them) as their parents: each by its best child.

    Adds n_children.  Children without a parent are passed over.  Errors while
    running are a hit whose chunk is not among `chunks`, a query none of whose
    hits has a parent, and a parent that is not among `parents` where they are
    given.
    """
    failed = lambda text, *names: F.raise_error(F.concat(F.lit(text), *names)).cast("string")
    link = chunks.select("chunk_id", "parent_id", F.lit(True).alias("known")).distinct()
    hits = children.select("query_id", "chunk_id", "rank", "score").join(link, "chunk_id", "left").withColumn(
        "parent_id", F.when(F.col("known"), F.col("parent_id")).otherwise(failed("hit of an unknown chunk: ", "chunk_id")),
    )
    if parents is not None:
        listed = parents.select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("listed")).distinct()
        hits = hits.join(listed, "parent_id", "left")
        hits = hits.withColumn(
            "parent_id",
            F.when(F.col("parent_id").isNull() | F.col("listed"), F.col("parent_id")).otherwise(failed("parent outside the chunk set of parents: ", "parent_id")),
        )
    hits = hits.withColumn("some", F.max("parent_id").over(Window.partitionBy("query_id")))
    hits = hits.withColumn(
        "parent_id",
        F.when(F.col("some").isNotNull(), F.col("parent_id")).otherwise(failed("no hit has a parent; are these chunks children? query ", "query_id")),
    ).filter("parent_id is not null")
    best = hits.groupBy("query_id", "parent_id").agg(F.min(F.struct("rank", "score")).alias("b"), F.countDistinct("chunk_id").alias("n_children"))
    w = Window.partitionBy("query_id").orderBy("b.rank", "parent_id")
    top = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.select("query_id", F.col("parent_id").alias("chunk_id"), F.col("b.score").alias("score"), "rank", F.lit(retriever).alias("retriever"), "n_children")


def without_overlaps(hits: DataFrame, chunks: DataFrame, k: int, threshold: float = 0.5, retriever: str = "sentence_window") -> DataFrame:
    """Ranked hits less those that overlap a better kept one of their document by more than `threshold` of the shorter.

    Greedy by rank, as an aggregate over a query's candidates (k times a
    fan-out of them, never more).
    """
    spans = chunks.select("chunk_id", "doc_id", "char_start", "char_end").dropDuplicates(["chunk_id"])
    rows = hits.join(spans, "chunk_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score", "doc_id", "char_start", "char_end"))).alias("c"))
    none = F.slice("c", 1, 0)
    share = lambda x, y: (F.least(x["char_end"], y["char_end"]) - F.greatest(x["char_start"], y["char_start"])) / F.least(x["char_end"] - x["char_start"], y["char_end"] - y["char_start"])
    clash = lambda x, y: (x["doc_id"] == y["doc_id"]) & (F.least(x["char_end"] - x["char_start"], y["char_end"] - y["char_start"]) > 0) & (share(x, y) > threshold)
    kept = F.aggregate("c", none, lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    out = rows.select("query_id", F.posexplode(kept).alias("at", "x")).filter(F.col("at") < k)
    return out.select("query_id", "x.chunk_id", "x.score", (F.col("at") + 1).alias("rank"), F.lit(retriever).alias("retriever"))


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks."""
    return joins.keep_matching(chunks, hits, ["chunk_id"], "inner")


def reranked(hits: DataFrame, queries: DataFrame, chunks: DataFrame, score: Callable[[Column, Column], Column] | None = None, k: int | None = None) -> DataFrame:
    """Hits ordered anew by a score of (query, text) columns; without one they stay as they are."""
    if score is None:
        return hits if k is None else hits.filter(F.col("rank") <= k)
    texts = chunks.select("chunk_id", "text").dropDuplicates(["chunk_id"])
    rows = hits.select("query_id", "chunk_id", "retriever").join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id")
    rows = rows.select("query_id", "chunk_id", "retriever", F.round(score(F.col("query"), F.col("text")).cast("double"), 6).alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return (rows if k is None else rows.filter(F.col("rank") <= k)).select("query_id", "chunk_id", "score", "rank", "retriever")


# Retrievers and the parameters that they have unless told otherwise.
RETRIEVERS: dict[str, dict] = {
    "dense": {},
    "bm25": {"k1": 1.5, "b": 0.75},
    "hybrid": {"k_rrf": 60, "weights": {"dense": 1.0, "bm25": 1.0}, "candidate_k": 50},
    "parent_doc": {"base": "dense", "base_params": {}, "fanout": 5, "parent_chunk_set": None},
    "sentence_window": {"base": "dense", "base_params": {}, "overlap_threshold": 0.5, "fanout": 3},
    "agent_router": {"model": "mock", "max_steps": 5, "mock": True},
}


def retrieve(
    name: str, queries: DataFrame, chunks: DataFrame, store: DataFrame, k: int, params: dict | None = None, embedder: str = "hash",
    embedder_params: dict | None = None,
) -> DataFrame:
    """Run a retriever by name over queries (query_id, query); composed ones build their bases with their own parameters."""
    from gleanery.settings import merged

    if name not in RETRIEVERS or name == "agent_router":
        raise ValueError(f"unknown retriever {name!r} here; there are {sorted(RETRIEVERS)}")
    p = merged(RETRIEVERS[name], params or {})
    again = lambda base, n, q=None: retrieve(base, queries, chunks, store, n, q, embedder, embedder_params)
    if name == "dense":
        return dense(embed_queries(queries, embedder, embedder_params), store, k)
    if name == "bm25":
        return bm25(queries, chunks, k, float(p["k1"]), float(p["b"]))
    if name == "hybrid":
        deep = max(int(p["candidate_k"]), k)
        return fuse({base: again(base, deep, p.get(base)) for base in ("dense", "bm25")}, k, int(p["k_rrf"]), p["weights"])
    base = again(p["base"], k * int(p["fanout"]), p["base_params"])
    if name == "parent_doc":
        return to_parents(base, chunks, k)
    return without_overlaps(base, chunks, k, float(p["overlap_threshold"]))
