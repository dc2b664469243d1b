"""Evaluation texts that leak into training text (problem 7).

Greedy string tiling on words: runs of `seed_words` words that a document
shares with an item are the seeds (13 for pairs, as short as a tile where coverage decides); the longest common stretches are marked as
tiles again and again, none overlapping another in either text, with running
Karp-Rabin hashes finding the matches of each length; the share of the item that
the tiles cover tells a leak, also where passages were put in another order.

The held-out items are the stated query set.  Their seed hashes go to the
workers in blocks of bounded size, so documents are read once for each block
and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gleanery.llm import batches, textcodes

#: Words of the items in one block; 8 bytes a word go to each worker, 16 MB at most.
BLOCK_WORDS = 2_000_000


@dataclass(frozen=True)
class Items:
    """Held-out items of one block: ids, flat word hashes with offsets, and seeds sorted by hash with their places among the words."""

    ids: list
    words: np.ndarray
    offsets: np.ndarray
    seeds: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list, seed_words: int) -> "Items":
        words, offsets = textcodes.words(texts)
        hashes, runs = textcodes.run_hashes(words, offsets, seed_words)
        places = np.arange(len(hashes)) + np.repeat(offsets[:-1] - runs[:-1], np.diff(runs))
        order = np.argsort(hashes, kind="stable")
        return cls(ids, words, offsets, hashes[order], places[order])

    def sharing(self, hashes: np.ndarray, seed_words: int, coverage: float) -> np.ndarray:
        """The items that have a seed among the hashes, and at least `coverage` of whose words lie in such seeds: no tiles cover more."""
        hashes = np.unique(hashes)
        first, last = np.searchsorted(self.seeds, hashes), np.searchsorted(self.seeds, hashes, side="right")
        first, n = first[last > first], (last - first)[last > first]
        if not len(n):
            return np.zeros(0, np.int64)
        places = np.sort(self.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)])
        owner = np.searchsorted(self.offsets, places, side="right") - 1
        room = np.full(len(places), seed_words)
        room[:-1] = np.where(owner[1:] == owner[:-1], np.minimum(np.diff(places), seed_words), seed_words)
        covered = np.bincount(owner, room, len(self.ids))
        return np.flatnonzero((covered > 0) & (covered >= coverage * np.diff(self.offsets) - 1e-6))


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (position in text, position in item, length), longest first.

    Lengths are tried by halving from the longest possible: Karp-Rabin hashes
    of all runs of a length tell whether a common unmarked run exists, so
    the longest one is found by bisection and marked with all others of its
    length that don't overlap.  Ties are taken from the left.
    """
    marked_text, marked_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    ends = np.array([0, len(text)]), np.array([0, len(item)])
    longest = min(len(text), len(item))

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        one, two = textcodes.run_hashes(text, ends[0], length)[0], textcodes.run_hashes(item, ends[1], length)[0]
        free_one = np.r_[0, np.cumsum(marked_text)]
        free_two = np.r_[0, np.cumsum(marked_item)]
        a = np.flatnonzero(free_one[length:] == free_one[:-length])
        b = np.flatnonzero(free_two[length:] == free_two[:-length])
        a = a[np.isin(one[a], two[b])]
        return a, b, one, two

    while longest >= least:
        low, high = least - 1, longest
        while low < high:  # the longest length with a common unmarked run
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        a, b, one, two = common(low)
        places: dict[int, list[int]] = {}
        for j in b.tolist():
            places.setdefault(int(two[j]), []).append(j)
        for i in a.tolist():
            if marked_text[i : i + low].any():
                continue
            for j in places[int(one[i])]:
                if not marked_item[j : j + low].any() and (text[i : i + low] == item[j : j + low]).all():
                    marked_text[i : i + low] = True
                    marked_item[j : j + low] = True
                    out.append((i, j, low))
                    break
        longest = low if len(common(low)[0]) else low - 1
    return out


def shared_stretches(text: np.ndarray, hits: np.ndarray, item: np.ndarray, seed_words: int) -> np.ndarray:
    """The words of a text that lie in seeds, those at `hits`, with a word that the item hasn't between stretches.

    Every tile no shorter than a seed lies in such a stretch, so tiling these
    words gives the tiles of the whole text, however long that is.
    """
    steps = np.zeros(len(text) + 1, np.int64)
    np.add.at(steps, hits, 1)
    np.subtract.at(steps, hits + seed_words, 1)
    inside = np.cumsum(steps)[:-1] > 0
    opens = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    strange = np.uint64(0)
    while (item == strange).any():
        strange += np.uint64(1)
    kept = np.flatnonzero(inside)
    return np.insert(text[kept], np.searchsorted(kept, opens), strange)


def _blocks(items: DataFrame, key: str, text: str, seed_words: int) -> Iterator[Items]:
    """The items with a key and a text, one row for each key and text, in blocks of bounded size."""
    ids: list = []
    texts: list = []
    size = 0
    for row in items.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null").distinct().toLocalIterator():
        n = len(row["text"]) // 2 + 1  # a text has at most so many words of two or more signs; single signs count double
        if size + n > BLOCK_WORDS and ids:
            yield Items.of(ids, texts, seed_words)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Items.of(ids, texts, seed_words)


def leaks(
    documents: DataFrame, items: DataFrame, seed_words: int = 13, tile_words: int | None = None, coverage: float = 0.0, key: str = "doc_id",
    item_key: str = "item_id", text: str = "text",
) -> DataFrame:
    """doc_id, item_id, longest_tile, tiles, covered_words, item_words for each document and item with a common run of `seed_words` words.

    Tiles shorter than `tile_words` (seed_words unless given) are not looked
    for; with tiles no shorter than seeds, pairs below `coverage` may be left
    out.  Null texts, rows with a null key and items with fewer than
    `seed_words` words have no match; rows sent again give one row.
    """
    tile_words = tile_words or seed_words
    if coverage and tile_words < seed_words:
        raise ValueError("a bound on coverage needs seeds no longer than tiles")
    spark = documents.sparkSession
    source = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    id_type = items.schema[item_key].dataType
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("item_id", id_type), *(T.StructField(c, T.IntegerType()) for c in ("longest_tile", "tiles", "covered_words", "item_words"))])
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, item_key, text, seed_words):
        shared = spark.sparkContext.broadcast((block.ids, block.words, block.offsets, block.seeds, block.places))

        def work(batch: pa.RecordBatch, texts: list, shared=shared) -> pa.RecordBatch | None:
            own = Items(*shared.value)
            words, offsets = textcodes.words(texts)
            hashes, runs = textcodes.run_hashes(words, offsets, seed_words)
            if not len(hashes) or not len(own.seeds):
                return None
            at = np.searchsorted(own.seeds, hashes)
            hit = np.flatnonzero(own.seeds[np.minimum(at, len(own.seeds) - 1)] == hashes)
            ends = np.searchsorted(hit, runs)  # a text's hits at a time: at most all seeds of the block are looked at together
            rows = []
            for t in np.flatnonzero(np.diff(ends)).tolist():
                at = hit[ends[t] : ends[t + 1]]
                text = words[offsets[t] : offsets[t + 1]]
                for i in own.sharing(hashes[at], seed_words, coverage).tolist():
                    item = own.words[own.offsets[i] : own.offsets[i + 1]]
                    if tile_words >= seed_words:
                        seeds = textcodes.run_hashes(item, np.array([0, len(item)]), seed_words)[0]
                        text_ = shared_stretches(text, at[np.isin(hashes[at], seeds)] - runs[t], item, seed_words)
                    else:
                        text_ = text
                    got = tiles(text_, item, min(tile_words, seed_words))
                    if got and got[0][2] >= seed_words:
                        rows.append((t, own.ids[i], got[0][2], len(got), sum(x[2] for x in got), len(item)))
            if not rows:
                return None
            columns = list(zip(*rows))
            doc = batches.column(batch, "doc_id").take(pa.array(columns[0]))
            return pa.RecordBatch.from_arrays(
                [doc, pa.array(columns[1], to_arrow_type(id_type)), *(pa.array(c, pa.int32()) for c in columns[2:])],
                names=[f.name for f in schema],
            )

        found = found.unionByName(batches.map_portions(source, schema, work))
    return found.distinct()


def leaked_pairs(documents: DataFrame, items: DataFrame, seed_words: int = 13, **keys: str) -> DataFrame:
    """doc_id, item_id of documents and items that have at least `seed_words` consecutive words in common."""
    return leaks(documents, items, seed_words, **keys).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, tile_words: int = 5, coverage: float = 0.5) -> DataFrame:
    """item_id, n_docs, best_coverage: items of which tiles of `tile_words` words or more cover at least `coverage` in some document.

    The seeds are as short as the tiles, so that the coverage alone decides.
    """
    share = F.col("covered_words") / F.col("item_words")
    found = leaks(documents, items, tile_words, coverage=coverage).filter(share >= coverage)
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.max(share), 6).alias("best_coverage"))
