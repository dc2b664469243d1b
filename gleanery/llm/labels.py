"""Canonical spellings of the labels that the tables write unevenly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.labels import SPLITS, look_up, split_name, tidy

__all__ = ["LANGUAGES", "SPLITS", "bare_id", "domain", "language", "split_name", "tidy"]

# Spellings in the data and what they mean.
LANGUAGES = {
    "de": "de", "deu": "de", "ger": "de", "german": "de", "en": "en", "eng": "en", "english": "en", "es": "es", "spa": "es", "spanish": "es",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "ja": "ja", "jp": "ja", "jpn": "ja", "japanese": "ja", "ru": "ru", "rus": "ru", "russian": "ru",
}


def language(value: Column) -> Column:
    """A two-letter code: the part before '-' or '_', looked up; 'und' for null, undetermined or unknown names."""
    return F.coalesce(look_up(LANGUAGES, F.regexp_extract(tidy(value), r"^([^-_]*)", 1)), F.lit("und"))


def domain(value: Column) -> Column:
    """Lower case without outer blanks; 'unknown' for null and blank."""
    name = tidy(value)
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(name)


def bare_id(value: Column) -> Column:
    """The last twelve hex digits of an id, in lower case; other signs are ignored; null where no digit is left.

    A prefix that names a corpus or a kind may hold letters a to f; they come
    before the last twelve digits and fall away.
    """
    digits = F.regexp_replace(F.lower(value), "[^0-9a-f]", "")
    short = F.substring(digits, -12, 12)
    return F.when(F.length(short) > 0, short)
