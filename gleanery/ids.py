"""Content-addressed ids, as column expressions and as plain Python for the driver.

Every id is the beginning of the SHA-1 of its parts, each followed by a NUL.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.settings import params_hash

DOC, CHUNK, QUERY, CELL = 12, 16, 16, 16
SPLITS = (("train", 0.6), ("dev", 0.8), ("test", 1.0))


def digest(*parts: object) -> str:
    return hashlib.sha1("".join(f"{p}\0" for p in parts).encode()).hexdigest()


def digest_column(*parts: Column) -> Column:
    """Null if any part is null."""
    return F.sha1(F.concat(*(F.concat(p.cast("string"), F.lit("\0")) for p in parts)))


def doc_id(corpus: Column, path: Column) -> Column:
    return F.substring(digest_column(corpus, F.regexp_replace(path, r"\\", "/")), 1, DOC)


def signature(chunker: str, params: dict) -> str:
    return f"{chunker}:{params_hash(params)}"


def chunk_id(doc: Column, start: Column, end: Column, sign: Column) -> Column:
    """Equal spans of one chunk set share an id; the physical key is (chunk_set_id, doc_id, ordinal)."""
    return F.substring(digest_column(doc, start, end, sign), 1, CHUNK)


def chunk_set_id(corpus: str, chunker: str, params: dict) -> str:
    return f"{corpus}__{chunker}__{params_hash(params)}"


def index_id(chunk_set: str, embedder: str, params: dict) -> str:
    return f"{chunk_set}__{embedder}__{params_hash(params)}"


def run_id(name: str, now: datetime | None = None) -> str:
    return f"{name}__{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%SZ}"


def query_id(corpus: Column, doc: Column, spans: Column, query: Column) -> Column:
    """`spans` is an array of structs (start, end) or of two-element arrays; its numbers are parts in order."""
    numbers = F.transform(spans, lambda s: F.concat(s.getItem(0).cast("string"), F.lit("\0"), s.getItem(1).cast("string"), F.lit("\0")))
    return F.substring(F.sha1(F.concat(corpus, F.lit("\0"), doc, F.lit("\0"), F.array_join(numbers, ""), query, F.lit("\0"))), 1, QUERY)


def cell_id(corpus: str, chunk_set: str, index: str, retriever: str, params: dict, k: int, split: str | None = None) -> str:
    """The eval split is a part where one is set, so that a resumed run never takes another split's cell."""
    parts = [corpus, chunk_set, index, retriever, params_hash(params), k]
    return digest(*parts, *([split] if split else []))[:CELL]


def split_of(query: Column) -> Column:
    """train, dev or test by the first eight hex digits of the id's digest."""
    share = F.conv(F.substring(digest_column(query), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    return F.when(share < SPLITS[0][1], SPLITS[0][0]).when(share < SPLITS[1][1], SPLITS[1][0]).when(share.isNotNull(), SPLITS[2][0])
