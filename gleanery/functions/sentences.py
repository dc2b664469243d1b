"""Sentences of a text, by one array pass over the places where one may end.

This is the only statement of the rule; the column function and the chunkers
call it with whole texts.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words after which a full stop ends no sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "eg", "ie", "inc", "ltd", "co", "corp",
    "no", "fig", "vol", "approx", "gen", "rep", "sen", "gov", "dept", "univ", "assoc", "bros",
)
# Fixed value: where a sentence may end, and what must follow.
BOUNDARY = r"[.!?]+[\"'’”)]*\s+(?=[A-Z0-9\"'‘“(#`\-*>|])"
_BOUNDARY = re.compile(BOUNDARY)
_LONGEST = max(map(len, ABBREVIATIONS))
_tables: list[np.ndarray] = []


def _word_signs() -> np.ndarray:
    """Whether each code point may stand in a word."""
    if not _tables:
        _tables.append(np.fromiter((chr(c).isalnum() or c == 0x5F for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _tables[0]


def sentence_edges(text: str) -> np.ndarray:
    """0, the end of each sentence, and so the text's length last; only 0 for an empty text.

    A sentence ends with closing punctuation and the white space after it,
    before a capital, a digit, a quote or a Markdown sign, unless a one-letter
    word or an abbreviation stands right before the punctuation.
    """
    places = np.array([m.span() for m in _BOUNDARY.finditer(text)], np.int64).reshape(-1, 2)
    ends = places[:, 1]
    if len(ends):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        outside = np.where(_word_signs()[codes], -1, np.arange(len(codes)))
        before = np.r_[-1, np.maximum.accumulate(outside)][places[:, 0]]  # the last sign ahead of the punctuation that is in no word
        length = places[:, 0] - before - 1
        stays = length == 1
        for k in np.flatnonzero((length > 1) & (length <= _LONGEST)).tolist():
            stays[k] = text[before[k] + 1 : places[k, 0]].lower() in ABBREVIATIONS
        ends = ends[~stays]
    return np.r_[0, ends[ends < len(text)], len(text)] if text else np.zeros(1, np.int64)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def edges(texts: pd.Series) -> pd.Series:
    """`sentence_edges` of a text column; null stays null."""
    return texts.map(lambda t: None if t is None else sentence_edges(t).astype(np.int32))
