"""Corpora of text files, as document rows."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import ids
from gleanery.functions import text as textual

log = logging.getLogger(__name__)

# File endings and what they hold; a provenance note that is no document.
ENDINGS = {"md": "markdown", "markdown": "markdown", "txt": "text"}
SKIPPED = "source.md"


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discover(spark: SparkSession, root: str) -> list[str]:
    """Sorted names of the folders below `root`; none if it doesn't exist."""
    fs, where = _filesystem(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def _listing(spark: SparkSession, folder: str, corpus: str, base: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # the path below `base`, from which ids are made; URI escapes are undone
    path = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"^\w+:/+", "/"), r"\+", "%2B"))
    inside = F.regexp_replace(path, "^.*?" + base.strip("/") + "/", "") if base else path
    rows = files.select(F.lit(corpus).alias("corpus"), inside.alias("source_path"), "content")
    return rows.withColumn("file", F.element_at(F.split("source_path", "/"), -1)).withColumn("ending", F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1)))


def unknown_files(spark: SparkSession, folder: str, corpus: str, base: str = "") -> DataFrame:
    """source_path of files that no loader takes."""
    rows = _listing(spark, folder, corpus, base)
    return rows.filter((F.lower("file") != SKIPPED) & ~F.col("ending").isin(list(ENDINGS))).select("source_path")


def load(spark: SparkSession, folder: str, corpus: str, base: str = "", warn: bool = True) -> DataFrame:
    """Document rows of all files below a folder, normalized, with title and counts; sort by source_path for a fixed order.

    A Markdown file's title is its first heading of level 1, else the file
    name in words; `base` is the folder that source paths are relative to.
    Files that no loader takes are left out and logged.
    """
    if warn:
        for row in unknown_files(spark, folder, corpus, base).limit(100).collect():
            log.warning("skipped a file of unknown kind: %s", row["source_path"])
    rows = _listing(spark, folder, corpus, base).filter((F.lower("file") != SKIPPED) & F.col("ending").isin(list(ENDINGS)))
    rows = rows.withColumn("text", textual.normalize(F.decode("content", "UTF-8"))).withColumn(
        "content_type", F.when(F.col("ending") == "txt", "text").otherwise("markdown"),
    )
    rows = rows.withColumn("h", textual.headings(F.col("text")))
    top = F.filter("h", lambda h: (h["level"] == 1) & (h["title"] != ""))
    title = F.when((F.col("content_type") == "markdown") & (F.size(top) > 0), F.get(top, F.lit(0))["title"])
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    chars = F.create_map(F.lit("char_count"), F.length("text").cast("string"))
    sections = F.create_map(F.lit("section_count"), F.size("h").cast("string"))
    return rows.select(
        ids.doc_id(
            F.col("corpus"), F.col("source_path"),
        ).alias("doc_id"), "corpus", "source_path", F.coalesce(title, textual.humanized(stem)).alias("title"), "text", "content_type",
        F.when(F.col("content_type") == "markdown", F.map_concat(chars, sections)).otherwise(chars).alias("meta"),
    )


def find_document(docs: DataFrame, doc_id: str) -> DataFrame:
    """The row of one id, none if there is none."""
    return docs.filter(F.col("doc_id") == doc_id).orderBy("source_path").limit(1)


def by_corpus(docs: DataFrame, corpus: str | None = None) -> DataFrame:
    return docs if corpus is None else docs.filter(F.col("corpus") == corpus)
