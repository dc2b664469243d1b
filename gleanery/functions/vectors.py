"""Vector arithmetic on array columns, in double precision, and the hashing embedder."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_DIM = 32


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """The vector by its length; a zero vector stays."""
    size = norm(v)
    size = F.when(size == 0, F.lit(1.0)).otherwise(size)
    # the length is an element of a list here, so that it is found once and not for each number
    return F.element_at(F.transform(F.array(size), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def truncated(v: Column, dim: int) -> Column:
    """The first `dim` numbers, normalized again."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    return l2_normalized(F.slice(v, 1, dim))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector counts as of length 1."""
    size = norm(a) * norm(b)
    return dot(a, b) / F.when(size == 0, F.lit(1.0)).otherwise(size)


class _WordTable:
    """The vectors of words met so far in a worker, as rows of one matrix.

    A word's vector is what a generator gives that the first eight bytes of the
    word's SHA-1 digest seed; a full table is emptied.
    """

    def __init__(self, dim: int, room: int = 200_000):
        self.dim, self.room = dim, room
        self.row: dict[str, int] = {}
        self.matrix = np.zeros((1024, dim))

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word in the matrix."""
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if len(self.row) + len(new) > self.room:
            self.row, new = {}, list(dict.fromkeys(words))
        at, need = len(self.row), len(self.row) + len(new)
        if need > len(self.matrix):
            self.matrix = np.vstack([self.matrix[:at], np.zeros((need * 3 // 2 - at, self.dim))])
        for k, word in enumerate(new, at):
            seed = int.from_bytes(hashlib.sha1(word.encode()).digest()[:8], "big")
            self.matrix[k] = np.random.default_rng(seed).normal(size=self.dim)
            self.row[word] = k
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))


_word_tables: dict[int, _WordTable] = {}
#: Words whose vectors are added at once, unless one text has more.
_WORDS_AT_ONCE = 50_000


def word_sums(texts: list[str], dim: int = HASH_DIM) -> np.ndarray:
    """For each text the sum of the vectors of its lower-case words; zeros for a text without words."""
    table = _word_tables.setdefault(dim, _WordTable(dim))
    out = np.zeros((len(texts), dim))
    words: list[str] = []
    sizes: list[int] = []
    for n, text in enumerate(texts):
        own = text.lower().split()
        words += own
        sizes.append(len(own))
        if len(words) >= _WORDS_AT_ONCE or n == len(texts) - 1:
            counts = np.array(sizes)
            some = np.flatnonzero(counts)
            if len(some):
                rows = table.rows(words)
                out[n + 1 - len(sizes) + some] = np.add.reduceat(table.matrix[rows], (np.cumsum(counts) - counts)[some], axis=0)
            words, sizes = [], []
    return out


def hash_vectors(texts: list[str], dim: int = HASH_DIM) -> np.ndarray:
    """Word sums as vectors of length 1 in single precision; a text without words counts as the empty word."""
    sums = word_sums(texts, dim)
    empty = np.array([not t.split() for t in texts], bool)
    if empty.any():
        table = _word_tables[dim]
        sums[empty] = table.matrix[table.rows([""])[0]]
    sizes = np.linalg.norm(sums, axis=1, keepdims=True)
    sums[sizes[:, 0] == 0, 0] = 1.0
    return (sums / np.where(sizes == 0, 1.0, sizes)).astype(np.float32)


@dataclass(frozen=True)
class EmbedderSpec:
    """What an embedder needs; `column` embedders read vectors that are there already, `model` ones need weights."""

    name: str
    kind: str
    dim: int
    query_prefix: str = ""
    doc_prefix: str = ""
    model: str = ""

    def params(self) -> dict:
        out = {"query_prefix": self.query_prefix, "doc_prefix": self.doc_prefix}
        if self.kind == "model":
            out |= {"normalize": True, "batch_size": 32, "truncate_dim": None, "strict_prefixes": True, "_nohash": ["batch_size"]}
        return out


# The known embedders, their sizes and prefixes.
EMBEDDERS = {
    "hash": EmbedderSpec("hash", "hash", HASH_DIM, "query: ", "passage: "),
    "bge-small": EmbedderSpec("bge-small", "model", 384, "Represent this sentence for searching relevant passages: ", "", "BAAI/bge-small-en-v1.5"),
    "e5-base": EmbedderSpec("e5-base", "model", 768, "query: ", "passage: ", "intfloat/e5-base-v2"),
    "e5-multilingual": EmbedderSpec("e5-multilingual", "model", 768, "query: ", "passage: ", "intfloat/multilingual-e5-base"),
    "minilm": EmbedderSpec("minilm", "model", 384, "", "", "sentence-transformers/all-MiniLM-L6-v2"),
}


def embedder_params(name: str, over: dict | None = None) -> dict:
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; there are {sorted(EMBEDDERS)}")
    return {**EMBEDDERS[name].params(), **(over or {})}


@lru_cache(maxsize=2)
def _model(name: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


def embedding(text: Column, name: str, params: dict | None = None, query: bool = False) -> Column:
    """The embedding of a text column as array<float>; queries and documents have their own prefixes. Null gives null."""
    spec, resolved = EMBEDDERS.get(name), embedder_params(name, params)
    prefix = resolved["query_prefix" if query else "doc_prefix"]
    dim = resolved.get("truncate_dim")
    if dim is not None and not 0 < int(dim) <= spec.dim:
        raise ValueError(f"truncate_dim must be in 1..{spec.dim}")
    if spec.kind == "model" and (spec.query_prefix or spec.doc_prefix) and not (resolved["query_prefix"] or resolved["doc_prefix"]) and resolved.get("strict_prefixes", True):
        raise ValueError(f"{name} needs its prefixes; set strict_prefixes=false to go without")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        some = texts[texts.notna()]
        if spec.kind == "hash":
            found = iter(hash_vectors([prefix + t for t in some], spec.dim))
            return pd.Series([next(found) if there else None for there in texts.notna()], index=texts.index, dtype=object)
        rows = _model(spec.model).encode([prefix + t for t in some], batch_size=int(resolved["batch_size"]), normalize_embeddings=bool(resolved["normalize"]))
        if dim is not None:
            rows = rows[:, : int(dim)]
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(rows.astype(np.float32)), index=some.index).reindex(texts.index)

    return run(text)
