"""Canonical spellings of split names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings in the data and what they mean.
SPLITS = {
    "train": "train", "training": "train", "trn": "train", "dev": "dev", "val": "dev", "valid": "dev", "validation": "dev",
    "development": "dev", "test": "test", "tst": "test", "testing": "test",
}


def look_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def tidy(value: Column) -> Column:
    """Lower case without outer white space of any kind."""
    return F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def split_name(value: Column) -> Column:
    """train, dev or test; null for null and for what is no split name."""
    return look_up(SPLITS, tidy(value))
