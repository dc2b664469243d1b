"""Statistics of corpora and chunk sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import sentences, text as textual

#: Chunks under so many tokens are orphans.
ORPHAN_TOKENS = 32


def percentiles(column: str) -> list:
    """Exact percentiles with linear interpolation."""
    return [F.percentile(column, F.lit(0.5)).alias("p50_tokens"), F.percentile(column, F.lit(0.95)).alias("p95_tokens")]


def corpus_stats(docs: DataFrame, key: str | None = None) -> DataFrame:
    """A row for each corpus: documents, tokens (sum, least, percentiles, most), headings, headings for 1000 tokens, fences, tables.

    With a `key`, rows of one key and equal counts are one document.
    """
    text = F.col("text")
    rows = docs.select(
        "corpus", *([key] if key else []), textual.portable_token_count(text).alias("tokens"), F.size(textual.headings(text)).alias("h"),
        textual.count_fences(text).alias("c"), textual.count_tables(text).alias("t"),
    )
    rows = rows.distinct() if key else rows
    sums = rows.groupBy("corpus").agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("min_tokens"), *percentiles("tokens"), F.max("tokens").alias("max_tokens"),
        F.sum(F.greatest("h", F.lit(0))).alias("headings"), F.sum("c").alias("code_blocks"), F.sum(F.greatest("t", F.lit(0))).alias("tables"),
    )
    return sums.withColumn("headings_per_1k", F.round(F.when(F.col("tokens") > 0, F.col("headings") * F.lit(1000.0) / F.col("tokens")).otherwise(F.lit(0.0)), 6))


def language_mix(docs: DataFrame, key: str | None = None) -> DataFrame:
    """corpus, label, docs: how many documents (rows, or distinct values of `key`) have each script label."""
    rows = docs.select("corpus", *([key] if key else []), textual.script_label(F.col("text")).alias("label"))
    return (rows.distinct() if key else rows).groupBy("corpus", "label").agg(F.count("*").alias("docs"))


def language_map(docs: DataFrame) -> DataFrame:
    """corpus, lang_mix: the mix as a map."""
    return language_mix(docs).groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("label", "docs"))).alias("lang_mix"))


def _regions(docs: DataFrame, kind: str) -> DataFrame:
    from gleanery.functions.markdown import tables

    import re

    from pyspark.sql import types as T

    spans_type = T.ArrayType(T.StructType([T.StructField("region_start", T.IntegerType()), T.StructField("region_end", T.IntegerType())]))
    find = tables if kind == "table" else lambda t: [m.span() for m in re.finditer(r"```.*?```", t, re.S)]

    @F.pandas_udf(spans_type)
    def spans(texts):
        return texts.map(lambda t: [{"region_start": a, "region_end": b} for a, b in find(t)] if t else [])

    marked = docs.filter(F.col("text").contains("```" if kind == "fence" else "|"))
    return marked.select("doc_id", F.explode(spans("text")).alias("r")).select("doc_id", "r.*")


def regions(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, region_start, region_end of fences or tables."""
    if kind not in ("fence", "table"):
        raise ValueError("kind is fence or table")
    return _regions(docs, kind)


def chunk_checks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, n_signs, covered_signs, wrong: what every chunking must keep to, for each document with a text.

    wrong counts chunks whose text isn't as long as their span, whose token
    count isn't that of their text, or that begin before the one before them.
    A right chunking covers all signs and has none.
    """
    from gleanery.operators.relations import coverage

    before = F.lag("char_start").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    odd = (F.length("text") != F.col("char_end") - F.col("char_start")) | (textual.portable_token_count(F.col("text")) != F.col("token_count"))
    rows = chunks.select("doc_id", "ordinal", "char_start", "char_end", odd.alias("odd")).distinct()
    rows = rows.withColumn("late", F.coalesce(before > F.col("char_start"), F.lit(False)))
    wrong = rows.groupBy("doc_id").agg(F.count(F.when(F.col("odd") | F.col("late"), 1)).alias("wrong"))
    return coverage(rows, docs).join(wrong, "doc_id", "left").select("doc_id", "n_signs", "covered_signs", F.coalesce("wrong", F.lit(0)).alias("wrong"))


def cut_sentences(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """`chunks` with cut: whether a boundary of the chunk lies strictly inside a sentence of its document.

    The places between sentences are a table, and chunk boundaries are joined
    with it as equal places: neither side grows with the other, and a document
    of many chunks is as many keys.
    """
    found = docs.filter("text is not null").select("doc_id", sentences.edges("text").alias("edges"))
    between = found.select("doc_id", F.explode("edges").alias("edge"))
    sizes = found.select(F.col("doc_id").alias("sentence_doc"), F.element_at("edges", -1).alias("sentence_chars"))
    rows = chunks.join(sizes, chunks["doc_id"] == F.col("sentence_doc"), "left").drop("sentence_doc")
    for side in ("start", "end"):
        own = between.select(F.col("doc_id").alias("sentence_doc"), F.col("edge").alias(f"sentence_{side}"))
        rows = rows.join(own, (rows["doc_id"] == own["sentence_doc"]) & (rows[f"char_{side}"] == own[f"sentence_{side}"]), "left").drop("sentence_doc")
    inside = lambda side: (F.col(f"char_{side}") > 0) & (F.col(f"char_{side}") < F.col("sentence_chars")) & F.col(f"sentence_{side}").isNull()
    return rows.withColumn("cut", F.coalesce(inside("start") | inside("end"), F.lit(False))).drop("sentence_chars", "sentence_start", "sentence_end")


def chunk_stats(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each chunk set: counts, token percentiles, split fences and tables, cut sentences, heading depth, orphans, build seconds."""
    from gleanery.operators.relations import split_regions

    if "depth" not in chunks.columns:
        chunks = chunks.withColumn("depth", F.size("heading_path"))
    built = F.col("meta")["chunk_build_seconds"] if "meta" in chunks.columns else F.lit(None)
    seconds = chunks.groupBy("chunk_set_id", "doc_id").agg(F.max(built.cast("double")).alias("s")).groupBy("chunk_set_id").agg(F.sum("s").alias("build_seconds"))
    rows = cut_sentences(chunks, docs)
    out = rows.groupBy("chunk_set_id").agg(
        F.count("*").alias("chunks"), F.min("token_count").alias("min_tokens"), *percentiles("token_count"), F.max("token_count").alias("max_tokens"),
        F.round(F.avg(F.col("cut").cast("double")), 6).alias("split_sentence_rate"), F.round(F.avg(F.col("depth").cast("double")), 6).alias("mean_heading_depth"),
        F.round(F.avg((F.col("token_count") < ORPHAN_TOKENS).cast("double")), 6).alias("orphan_rate"), F.countDistinct("doc_id").alias("docs"),
    )
    sets = chunks.select("chunk_set_id", "doc_id").distinct()
    for kind in ("fence", "table"):
        places = regions(docs, kind).join(sets, "doc_id")
        total = places.groupBy("chunk_set_id").agg(F.count("*").alias(f"{kind}s"))
        edges = chunks.select("chunk_set_id", "doc_id", "char_start", "char_end")
        split = split_regions(
            edges.withColumn("doc_id", F.concat_ws("\0", "chunk_set_id", "doc_id")),
            places.withColumn("doc_id", F.concat_ws("\0", "chunk_set_id", "doc_id")),
        ).groupBy("chunk_set_id").agg(F.count("*").alias(f"split_{kind}s"))
        out = out.join(total, "chunk_set_id", "left").join(split, "chunk_set_id", "left")
    return out.join(seconds, "chunk_set_id", "left").fillna(0, ["fences", "split_fences", "tables", "split_tables"])
