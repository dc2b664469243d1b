"""Text functions on columns; built-in expressions wherever they can say it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import sentences
from gleanery.functions.tokens import TOKEN

# The first label whose signs a text holds names its script.
SCRIPTS = (
    ("ja", "[぀-ヿㇰ-ㇿ]"), ("zh", "[一-鿿]"), ("ko", "[가-힣]"), ("ru", "[Ѐ-ӿ]"), ("ar", "[؀-ۿ]"),
    ("hi", "[ऀ-ॿ]"), ("de", "[ßäöüÄÖÜ]"), ("es", "[ñÑ¿¡]"), ("fr", "[œŒçàâêîïôûéèÇÀÂÊÎÏÔÛÉÈ]"),
)
# Patterns of fenced code, headings and the separator rows of tables.
FENCE = r"(?s)```.*?```"
HEADING = r"(?md)^(#{1,6})[ \t]+(.+?)[ \t]*$"
SEPARATOR_ROW = r"^\s*\|*\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|*\s*$"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize(text: Column) -> Column:
    """NFC, LF line ends, no blanks at line ends, at most one empty line in a row, stripped, one LF at the end. Null stays null."""
    lines = F.regexp_replace(_nfc(text), r"\r\n?", "\n")
    lines = F.regexp_replace(lines, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    lines = F.regexp_replace(lines, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(lines, r"(?U)\A\s+|\s+\z", ""), F.lit("\n"))


def mask_fences(text: Column) -> Column:
    """Fenced blocks replaced by as many line ends as they hold; an unclosed fence stays."""
    outside = F.split(text, FENCE, -1)
    blocks = F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), lambda b: F.regexp_replace(b, r"[^\n]", ""))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(outside.alias("o"), blocks.alias("b")), lambda z: F.array(z["o"], F.coalesce(z["b"], F.lit(""))))), "")


def count_fences(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(FENCE)), F.lit(0))


def headings(text: Column) -> Column:
    """array<struct<level, title>> of the ATX headings outside fences."""
    found = F.regexp_extract_all(mask_fences(text), F.lit(HEADING), F.lit(0))
    return F.transform(
        found,
        lambda h: F.struct(
            F.length(F.regexp_extract(h, r"^#+", 0)).alias("level"),
            F.regexp_replace(F.regexp_replace(h, r"^#+[ \t]+", ""), r"(?U)^\s+|\s+$", "").alias("title"),
        ),
    )


def is_separator_row(line: Column) -> Column:
    """A table's separator row: has a pipe, and each cell is three or more dashes with optional colons."""
    return line.contains("|") & line.rlike(SEPARATOR_ROW)


def count_tables(text: Column) -> Column:
    return F.size(F.filter(F.split(mask_fences(text), "\n"), is_separator_row))


def script_label(text: Column) -> Column:
    label = F.lit("en")
    for name, pattern in reversed(SCRIPTS):
        label = F.when(text.rlike(pattern), name).otherwise(label)
    return F.when(text.isNotNull(), label)


def portable_token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def lexical_terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(_SPANS)
def sentence_spans(texts: pd.Series) -> pd.Series:
    """array<struct<start, end>>: contiguous sentences; blanks at a sentence's end belong to it. Null stays null."""
    edges = texts.map(lambda t: None if t is None else sentences.sentence_edges(t).tolist())
    return edges.map(lambda at: None if at is None else [{"start": a, "end": b} for a, b in zip(at, at[1:])])


def preview(text: Column, width: int = 60) -> Column:
    """White space collapsed, cut to `width` signs with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 1), F.lit("…")))


def humanized(stem: Column) -> Column:
    """'auth-token_lifecycle' as 'Auth Token Lifecycle'."""
    words = F.filter(F.split(stem, "[-_]+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " ")
    return F.when(title == "", stem).otherwise(title)


def has_identifier(text: Column) -> Column:
    """Whether a word of capitals joined by underscores occurs."""
    return text.rlike(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b")
