"""Joins between chunks, spans, parents and regions; every one has the document as its equality key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve_gold(pairs: DataFrame, chunks: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """query_id, span_no, chunk_id: chunks that count as gold for each span of a query.

    A chunk counts if the intersection is at least `min_overlap` of the span or
    of the chunk; empty spans and empty chunks never count.
    """
    spans = pairs.select("query_id", F.col("gold_doc_id").alias("doc_id"), F.posexplode("gold_char_spans").alias("span_no", "span"))
    spans = spans.select("query_id", "doc_id", "span_no", F.col("span").getItem(0).alias("s"), F.col("span").getItem(1).alias("e"))
    both = spans.join(chunks.select("doc_id", "chunk_id", "char_start", "char_end"), "doc_id").filter("s < char_end and char_start < e")
    inter = F.least("e", "char_end") - F.greatest("s", "char_start")
    counts = (inter / (F.col("e") - F.col("s")) >= min_overlap) | (inter / (F.col("char_end") - F.col("char_start")) >= min_overlap)
    return both.filter("e > s and char_end > char_start").filter(counts).select("query_id", "span_no", "chunk_id").distinct()


def assign_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with parent_id: the parent whose span holds the child's midpoint; the smallest, then the earliest one. Null for orphans."""
    middle = (F.col("c.char_start") + F.col("c.char_end")) / 2
    hit = (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.char_start") <= middle) & (middle < F.col("p.char_end"))
    best = (
        children.alias("c").join(parents.alias("p"), hit)
        .groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.ordinal").alias("ordinal"))
        .agg(F.min(F.struct((F.col("p.char_end") - F.col("p.char_start")).alias("size"), F.col("p.char_start").alias("start"), F.col("p.chunk_id").alias("id"))).alias("best"))
    )
    return children.drop("parent_id").join(best, ["doc_id", "ordinal"], "left").withColumn("parent_id", F.col("best.id")).drop("best")


def orphans(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children without a parent; a build with any of them must fail."""
    return assign_parents(children, parents).filter("parent_id is null")


def require_parents(children: DataFrame, parents: DataFrame) -> DataFrame:
    """assign_parents that fails while running if a child has no parent."""
    assigned = assign_parents(children, parents)
    return assigned.withColumn("parent_id", F.coalesce("parent_id", F.raise_error(F.concat(F.lit("no parent for chunk "), "chunk_id")).cast("string")))


def split_regions(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (doc_id, region_start, region_end) that some chunk boundary lies strictly inside of."""
    edges = chunks.select("doc_id", F.explode(F.array("char_start", "char_end")).alias("edge")).distinct()
    inside = (edges["doc_id"] == regions["doc_id"]) & (edges["edge"] > regions["region_start"]) & (edges["edge"] < regions["region_end"])
    return regions.join(edges, inside, "left_semi")


def overlap_with_previous(chunks: DataFrame) -> DataFrame:
    """doc_id, ordinal, shared: signs that each chunk shares with the one before it in the document."""
    before = F.lag("char_end").over(Window.partitionBy("chunk_set_id", "doc_id").orderBy("char_start", "char_end", "ordinal"))
    return chunks.select("chunk_set_id", "doc_id", "ordinal", F.greatest(F.coalesce(before - F.col("char_start"), F.lit(0)), F.lit(0)).alias("shared"))


def covered_spans(chunks: DataFrame) -> DataFrame:
    """doc_id, char_start, char_end: the stretches that chunks cover, each once; overlapping and touching chunks make one."""
    w = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    reach = F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.filter("char_end > char_start").select("doc_id", "char_start", "char_end").distinct()
    rows = rows.withColumn("opens", F.when(F.col("char_start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "island").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")).drop("island")


_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("n_signs", "covered_signs")]))
def _signs(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for text, a, b in zip(texts, starts, ends):
        codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = ~np.isin(codes, _SPACES)
        before = np.r_[0, np.cumsum(signs)]
        at = [np.clip(np.asarray(x if x is not None else [], np.int64), 0, len(signs)) for x in (a, b)]
        rows.append((int(before[-1]), int((before[at[1]] - before[at[0]]).sum())))
    return pd.DataFrame(rows, columns=["n_signs", "covered_signs"])


def coverage(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, covered, n_signs, covered_signs, ratio: how much of each document with a text lies in some chunk.

    n_chars and covered count all signs, n_signs, covered_signs and their ratio
    those that are no white space; the ratio of a document without any is 1.
    """
    spans = covered_spans(chunks).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("char_start", "char_end"))).alias("s"))
    texts = docs.filter("text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = texts.join(spans, "doc_id", "left")
    n = F.length("text")
    part = lambda name: F.transform("s", lambda x: x[name])
    covered = F.aggregate("s", F.lit(0), lambda total, x: total + F.greatest(F.least(x["char_end"], n) - F.greatest(x["char_start"], F.lit(0)), F.lit(0)))
    rows = rows.select("doc_id", n.alias("n_chars"), F.coalesce(covered, F.lit(0)).alias("covered"), _signs("text", part("char_start"), part("char_end")).alias("k"))
    ratio = F.when(F.col("k.n_signs") > 0, F.round(F.col("k.covered_signs") / F.col("k.n_signs"), 6)).otherwise(F.lit(1.0))
    return rows.select("doc_id", "n_chars", "covered", "k.n_signs", "k.covered_signs", ratio.alias("ratio"))


#: Characters of needles that go to the workers at once.
NEEDLE_CHARS = 4_000_000


def needle_evalset(docs: DataFrame, needles: DataFrame, once: bool = False) -> DataFrame:
    """Eval pairs anchored by needles (needle_id, corpus, query, needles array): the first document of the corpus, by path, that holds all needles.

    Spans are first occurrences, 0-based and half open; null and empty needles
    are left out, and a pair without any has no host.  With `once` a needle that
    stands in its host twice is an error while running.  The needles are the
    stated query set: they are matched by an automaton in one pass over
    the documents for each block of needles of bounded size.
    """
    spark = docs.sparkSession
    asked = needles.select(
        "needle_id", "corpus", F.array_distinct(F.filter("needles", lambda n: n.isNotNull() & (n != ""))).alias("needles"),
    ).filter("size(needles) > 0")
    schema = "needle string, doc_id string, corpus string, source_path string, at int, times int"
    found = spark.createDataFrame([], schema)

    def scan(words: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(words)

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in shared.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for frame in frames:
                rows = []
                for doc, corpus, path, text in frame.itertuples(index=False):
                    first: dict[str, int] = {}
                    times: dict[str, int] = {}
                    for end, word in automaton.iter(text):
                        first.setdefault(word, end + 1 - len(word))
                        times[word] = times.get(word, 0) + 1
                    rows.extend((word, doc, corpus, path, at, times[word]) for word, at in first.items())
                yield pd.DataFrame(rows, columns=["needle", "doc_id", "corpus", "source_path", "at", "times"])

        return docs.select("doc_id", "corpus", "source_path", "text").filter("text is not null").mapInPandas(run, schema)

    block: list[str] = []
    size = 0
    for row in asked.select(F.explode("needles").alias("needle")).distinct().toLocalIterator():
        block.append(row["needle"])
        size += len(row["needle"])
        if size > NEEDLE_CHARS:
            found, block, size = found.unionByName(scan(block)), [], 0
    if block:
        found = found.unionByName(scan(block))
    one = asked.select("needle_id", "corpus", F.size("needles").alias("n"), F.posexplode("needles").alias("place", "needle"))
    hits = one.join(found, ["needle", "corpus"]).groupBy("needle_id", "corpus", "n", "doc_id", "source_path").agg(
        F.countDistinct("place").alias("have"), F.max("times").alias("times"), F.sort_array(F.collect_set(F.struct("place", F.array(F.col("at"), F.col("at") + F.length("needle")).alias("span")))).alias("spans"))
    host = hits.filter("have = n").groupBy("needle_id", "corpus").agg(F.min_by(F.struct("doc_id", "spans", "times"), F.struct("source_path", "doc_id")).alias("host"))
    if once:
        host = host.filter(F.when(F.col("host.times") > 1, F.raise_error(F.concat(F.lit("a needle repeats in its document: "), "needle_id")).cast("boolean")).otherwise(True))
    pairs = host.select("needle_id", "corpus", F.col("host.doc_id").alias("gold_doc_id"), F.transform("host.spans", lambda s: s["span"]).alias("gold_char_spans"))
    return pairs.join(needles.select("needle_id", "corpus", "query").distinct(), ["needle_id", "corpus"])
