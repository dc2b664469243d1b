"""Pairs of records whose sets of word runs are similar, without pairwise comparison.

One 64-bit hash function stands for the runs.  Records with equal sets are one
class, and everything below works on one text of each class, so copies cost
nothing.  A class has two bottom-k sketches of its set:

* the *retained values* of the inverted lists: the bottom n - ceil(t n) + h
  values in the order (frequency class, hash).  Two sets with Jaccard >= t share
  at least h retained values (or all that they must share, if that is less),
  whatever the order is, so no pair is lost; the order only decides how long
  the lists become.
* a bottom-32 sketch in plain hash order, for the union-sketch estimate.

Candidates come from the inverted lists under exact size and position bounds,
the union sketch estimates their similarity, and the exact sets decide.

Frequency classes come from a count table (one slot for each value of some hash
bits) over all classes.  It has as many slots as the data calls for, 16 million
at most, so that what is broadcast is bounded.  With so much data that a slot
holds many values, it can't tell stock phrases from rare ones any more; then
the lists that the order makes are counted exactly, the values of the long ones
go to the end of the order, and this is done again for the values that took
their places.  A list that is still longer than a block in the end goes on to a second stage with its exact length: its rows are split into
blocks there, and each pair of blocks is a group of its own.  No row of another
list is copied, whatever the count table says.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import joins, scratch
from gleanery.llm import batches, textcodes

#: Least and most bits of the slot number in the count table (64 MB for a worker and 16 MB when broadcast at most), and values for one slot.
SLOT_BITS = (10, 24)
SLOT_VALUES = 8
SLICES = 256
#: Values in the sketch for the estimate.
SKETCH = 32
#: Rows of one block of a long inverted list.
BLOCK = 1024
#: Values for one slot from which on lists are counted; rows of a list whose value goes to the end of the order; rounds of counting; values that are told apart so, at most (48 MB when broadcast).
CROWDED, LONG_LIST, COUNT_ROUNDS, STOCK_VALUES = 64, 128, 4, 4_000_000
#: Values of pairs that are compared at once.
COMPARED = 2_000_000
#: Pairs of lists that a worker holds at most, besides those of one step over an Arrow batch, and rows of a batch of them.
PAIRS_HELD, PAIRS_SENT = 1_000_000, 100_000
#: Bits of a posting's tag above its role and its block: rows of another block, rows late in their set.
_OTHER, _LATE = 40, 41


@dataclass(frozen=True)
class Measure:
    """What counts as similar: distinct runs of `run_length` words, Jaccard >= threshold, for records of at least `min_words` words.

    A candidate shares at least `overlaps` retained values (h above): several
    where sets have dozens of values, one where they have few.  With `cross_only`
    a pair needs a record of role 1 on one side and of role 2 on the other.  The
    union sketch misses a pair at the threshold with probability `miss` at most;
    with 0 it rules out none and every candidate is compared exactly.
    """

    run_length: int = 5
    threshold: float = 0.8
    min_words: int = 1
    cross_only: bool = False
    overlaps: int = 3
    miss: float = 1e-8

    def needed(self, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """The least overlap of two sets that are similar."""
        return np.ceil(self.threshold / (1 + self.threshold) * (n_a + n_b) - 1e-9)

    def retained(self, n: np.ndarray) -> np.ndarray:
        return n - np.ceil(self.threshold * n - 1e-9).astype(np.int64) + self.overlaps

    def least_sketch_hits(self) -> int:
        """Hits in a union sketch of SKETCH values that a similar pair misses with probability `miss` at most."""
        t, tail, hits = self.threshold, 0.0, 0
        while True:
            tail += math.comb(SKETCH, hits) * t**hits * (1 - t) ** (SKETCH - hits)
            if tail > self.miss:
                return hits
            hits += 1


def value_sets(texts: list, parts: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct run hashes of each text (none for texts under min_words words) and offsets."""
    found, offsets = textcodes.words(texts)
    short = np.diff(offsets) < measure.min_words
    hashes, runs = textcodes.run_hashes(found, offsets, measure.run_length)
    counts = np.diff(runs)
    hashes = hashes ^ textcodes.mix(np.repeat(parts, counts).astype(np.uint64) + np.uint64(1))
    keep = np.repeat(~short, counts)
    counts = np.where(short, 0, counts)
    ends = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=ends[1:])
    return textcodes.distinct_sorted(hashes[keep], ends)


def class_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, the same for equal sets; 0 for an empty one."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(textcodes.mix(values * np.uint64(0xD6E8FEB86659FD93)), out=prefix[1:])
    sizes = np.diff(offsets).astype(np.uint64)
    keys = textcodes.mix((prefix[offsets[1:]] - prefix[offsets[:-1]]) ^ (sizes * np.uint64(0x9E3779B97F4A7C15)))
    return np.where(sizes > 0, keys, np.uint64(0)).astype(np.uint64)


def _binaries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of a flat array as binary values."""
    width, raw = data.dtype.itemsize, np.ascontiguousarray(data).tobytes()
    return pa.array([raw[a * width : b * width] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())


def _members(records: DataFrame, measure: Measure) -> DataFrame:
    """Per record with enough words its class, the size of its set and the hash of its text."""
    kept = ("part", "record", "owner", "role", "th")

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        values, offsets = value_sets(texts, batches.column(batch, "part").to_numpy(zero_copy_only=False), measure)
        some = np.flatnonzero(np.diff(offsets))
        picked = batch.take(pa.array(some))
        columns = [batches.column(picked, c) for c in kept]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(class_keys(values, offsets)[some].view(np.int64)), pa.array(np.diff(offsets)[some].astype(np.int32))],
            names=[*kept, "cls", "n"],
        )

    return batches.map_portions(records, "part int, record string, owner string, role int, th long, cls long, n int", work)


def _classes(records: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each class: cls, part, role (of all its records), n and one of its texts.

    Equal texts are put together before the shuffle, so that a text of many
    copies is shipped once for each task at most, and once from there on.
    """
    first = members.groupBy("cls").agg(F.min(F.struct("part", "th")).alias("first"), F.bit_or("role").alias("role"), F.max("n").alias("n"))
    first = first.select("cls", "first.part", "first.th", "role", "n")
    texts = records.groupBy("part", "th").agg(F.min("text").alias("text"))
    return texts.join(first.hint("shuffle_merge"), ["part", "th"]).select("cls", "part", "role", "n", "text")


def _slot_bits(classes: DataFrame) -> int:
    values = classes.agg(F.sum("n")).first()[0] or 1
    return min(max(math.ceil(math.log2(values / SLOT_VALUES + 1)), SLOT_BITS[0]), SLOT_BITS[1])


def _summaries(classes: DataFrame, measure: Measure, bits: int) -> DataFrame:
    """Per class its sketch (tag 0); per task the slot counts of the values of its classes (tag 1)."""
    schema = pa.schema([("tag", pa.int32()), ("cls", pa.int64()), ("sketch", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])
    slices = min(SLICES, 1 << bits)

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << bits, np.uint32)
        for batch, texts in batches.portions(stream):
            values, offsets = value_sets(texts, batches.column(batch, "part").to_numpy(zero_copy_only=False), measure)
            slot, counts = np.unique((values >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            slots[slot] += counts.astype(np.uint32)
            n, starts = len(texts), offsets[:-1]
            sketch = _binaries((values >> np.uint64(32)).astype(np.uint32), starts, starts + np.minimum(np.diff(offsets), SKETCH))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), batches.column(batch, "cls"), sketch, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                schema=schema,
            )
        if slots.any():
            some = [(k, zlib.compress(piece.tobytes(), 1)) for k, piece in enumerate(slots.reshape(slices, -1)) if piece.any()]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                    pa.array([k for k, _ in some], pa.int32()), pa.array([v for _, v in some], pa.binary()),
                ],
                schema=schema,
            )

    return classes.mapInArrow(run, "tag int, cls long, sketch binary, slice int, counts binary")


def _levels(summaries: DataFrame, bits: int) -> np.ndarray:
    """log2 of the count of each slot: 2^bits bytes, the sum over all tasks."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in stream:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[k] = sums[k] + counts if k in sums else counts.astype(np.int64)
        levels = [(k, zlib.compress(np.floor(np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes(), 1)) for k, v in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in levels], pa.int32()), pa.array([v for _, v in levels], pa.binary())], names=["slice", "levels"])

    rows = summaries.filter("tag = 1").select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, levels binary").collect()
    slices = min(SLICES, 1 << bits)
    out = np.zeros((slices, (1 << bits) // slices), np.uint8)
    for row in rows:
        out[row["slice"]] = np.frombuffer(zlib.decompress(bytes(row["levels"])), np.uint8)
    return out.ravel()


@dataclass(frozen=True)
class Order:
    """What ranks values before their hashes do: the level of their slot, above all levels the length of a stock value's list."""

    levels: np.ndarray
    stock: np.ndarray
    ranks: np.ndarray

    def of(self, values: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - int(math.log2(len(self.levels))))
        out = self.levels[(values >> shift).astype(np.int64)]
        if len(self.stock):
            at = np.minimum(np.searchsorted(self.stock, values), len(self.stock) - 1)
            out = np.where(self.stock[at] == values, self.ranks[at], out)
        return out


def _order(classes: DataFrame, summaries: DataFrame, measure: Measure, bits: int):
    """The broadcast order; see the module's text for what is counted when."""
    spark = classes.sparkSession
    none = np.zeros(0, np.uint64)
    order = spark.sparkContext.broadcast(Order(_levels(summaries, bits), none, none.astype(np.uint8)))
    if (classes.agg(F.sum("n")).first()[0] or 0) <= CROWDED << bits:
        return order
    stock = None
    for _ in range(COUNT_ROUNDS):
        lengths = _postings(classes, order, measure).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LONG_LIST)
        new = scratch.materialize(lengths, "similar-lengths")
        if new.isEmpty():
            break
        stock = new if stock is None else stock.unionByName(new).groupBy("key").agg(F.max("n").alias("n"))
        stock = scratch.materialize(stock.withColumn("level", F.floor(F.log2("n")).cast("int")), "similar-stock")
        # only as many values as may be broadcast, those of the longest lists
        held = {r["level"]: r["k"] for r in stock.groupBy("level").agg(F.count("*").alias("k")).collect()}
        least = next(x for x in range(65) if sum(k for level, k in held.items() if level >= x) <= STOCK_VALUES)
        stock = stock.filter(F.col("level") >= least)
        found = stock.select("key", "level").toPandas()  # STOCK_VALUES rows at most
        keys = found["key"].to_numpy(np.int64).view(np.uint64)
        place = np.argsort(keys)
        order = spark.sparkContext.broadcast(Order(order.value.levels, keys[place], (100 + found["level"].to_numpy()[place]).astype(np.uint8)))
        stock = stock.drop("level")
    return order


def _postings(classes: DataFrame, order, measure: Measure) -> DataFrame:
    """Inverted-list rows: key (the value), class, set size, position in the order, and a tag of role and lateness. One row for each retained value of each class."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = order.value
        for batch, texts in batches.portions(stream):
            values, offsets = value_sets(texts, batches.column(batch, "part").to_numpy(zero_copy_only=False), measure)
            if not len(values):
                continue
            roles = batches.column(batch, "role").to_numpy(zero_copy_only=False).astype(np.int64)
            classes_ = batches.column(batch, "cls").to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(texts)), sizes)
            values = values[np.lexsort((values, ranked.of(values), owner))]
            position = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
            n = sizes[owner]
            kept = position < measure.retained(n)
            values, owner, position, n = values[kept], owner[kept], position[kept], n[kept]
            # in the smaller set of a similar pair the shared values come early; a row is late where they can't any more
            late = position > n - measure.needed(n, n).astype(np.int64) + measure.overlaps - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values.view(np.int64)), pa.array(classes_[owner]), pa.array(n.astype(np.int32)),
                    pa.array(position.astype(np.int32)), pa.array((late.astype(np.int64) << _LATE) | roles[owner]),
                ],
                names=["key", "cls", "n", "pos", "tag"],
            )

    return classes.select("cls", "part", "role", "text").mapInArrow(run, "key long, cls long, n int, pos int, tag long")


_LISTED = "key long, a long, b long, x int, y int, tag long"


def _list_pairs(block: np.ndarray, measure: Measure) -> Iterator[pa.RecordBatch]:
    """Of whole lists: pairs of classes (a, b) with x, the retained values they share here, and y, how many they must share.

    Lists have as many pairs as the square of their rows, so no more than
    PAIRS_HELD are held at once; a pair comes in several rows then, whose x add up.
    """
    lists = np.cumsum(np.r_[False, block[0][1:] != block[0][:-1]])
    block = block[:, np.argsort(lists * 2 + (block[4] >> _LATE), kind="stable")]  # early rows come first in a list
    key, cls, n, pos, tag = (block[c] for c in range(5))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[first, len(key)])
    end = np.repeat(first + lengths, lengths)
    role, list_block, cross, late = tag & 3, (tag >> 2) & ((1 << 38) - 1), (tag >> _OTHER & 1).astype(bool), (tag >> _LATE).astype(bool)
    # two late rows are no candidate
    index, step, out, held = np.flatnonzero(~late), 1, [], 0
    while True:
        index = index[index + step < end[index]]
        if not len(index):
            break
        x, y = index, index + step
        n_x, n_y = n[x], n[y]
        good = (cls[x] != cls[y]) & (np.minimum(n_x, n_y) >= measure.threshold * np.maximum(n_x, n_y) - 1e-9)
        # the first `overlaps` shared values of a similar pair all pass this bound
        needed = measure.needed(n_x, n_y)
        good &= measure.overlaps + np.minimum(n_x - pos[x], n_y - pos[y]) - 1 >= needed
        good &= ~cross[x] | (list_block[x] != list_block[y])
        if measure.cross_only:
            good &= (role[x] | role[y]) == 3
        if good.any():
            x, y = x[good], y[good]
            least = np.minimum(needed[good], measure.overlaps).astype(np.int64)
            out.append(np.stack([np.ones(len(x), np.int64), least, np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])]))
            held += len(x)
        if held > PAIRS_HELD:
            out = [_added_up(out)]
            held = out[0].shape[1]
            if held > PAIRS_HELD // 2:  # few of them are the same
                yield from _sent(out[0])
                out, held = [], 0
        step += 1
    if out:
        yield from _sent(_added_up(out))


def _added_up(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of x, y, a, b, one for each pair; empties the list, so that the parts don't lie beside their sum."""
    found = np.concatenate(parts, axis=1)
    parts.clear()
    found = found[:, np.lexsort(found[2:])]  # y follows from the sizes of a and b
    first = np.flatnonzero(np.r_[True, (found[2:, 1:] != found[2:, :-1]).any(axis=0)])
    shared = np.add.reduceat(found[0], first)
    found = found[:, first]
    found[0] = shared
    return found


def _sent(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, found.shape[1], PAIRS_SENT):
        shared, least, a, b = found[:, i : i + PAIRS_SENT]
        yield _listed(np.zeros(len(a), np.int64), a, b, shared, least, np.full(len(a), -1))


def _listed(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "a", "b", "x", "y", "tag"])


def _lists(postings: DataFrame, measure: Measure, keys: list[str], whole: bool) -> DataFrame:
    """Pairs (tag -1) of the lists, as _list_pairs gives them.

    Unless `whole`, the rows of a list of more than BLOCK rows come back as
    they are (key, a = class, x = size, y = position, tag) for the second
    stage, as soon as the list turns out to be one: none is held in memory.
    """

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, long_key = np.zeros((5, 0), np.int64), None
        for batch in stream:
            block = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[-5:]])], axis=1)
            yield from lists(block[:, : (last := int(np.searchsorted(block[0], block[0][-1])) if block.shape[1] else 0)], long_key)
            rest = block[:, last:]  # the last list may go on in the next batch
            if last:
                long_key = None
            if not whole and (rest.shape[1] > BLOCK or (rest.shape[1] and rest[0][0] == long_key)):
                long_key = int(rest[0][0])
                yield long_rows(rest)
                rest = rest[:, :0]
        yield from lists(rest, long_key)

    def long_rows(block: np.ndarray) -> pa.RecordBatch:
        return _listed(block[0], block[1], np.zeros(block.shape[1], np.int64), block[2], block[3], block[4])

    def lists(block: np.ndarray, long_key: int | None) -> Iterator[pa.RecordBatch]:
        if not block.shape[1]:
            return
        if not whole:
            first = np.flatnonzero(np.r_[True, block[0][1:] != block[0][:-1]])
            lengths = np.diff(np.r_[first, block.shape[1]])
            long = np.repeat((lengths > BLOCK) | (block[0][first] == long_key if long_key is not None else False), lengths)
            if long.any():
                yield long_rows(block[:, long])
                block = block[:, ~long]
        if block.shape[1] > 1:
            yield from _list_pairs(block, measure)

    return postings.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _LISTED)


def _split_lists(long: DataFrame) -> DataFrame:
    """The rows of long lists, once for each group that they belong to: a pair of blocks of early rows, or a block of early and one of late rows.

    Late rows only meet early ones, so a list without an early row makes no
    group.  Lengths are exact; they are put together before they are shuffled.
    """
    late = F.shiftright("tag", _LATE) == 1
    sizes = long.groupBy("key").agg(F.count(F.when(~late, 1)).alias("early"), F.count(F.when(late, 1)).alias("late")).filter("early > 0")
    sizes = scratch.materialize(sizes.select("key", F.ceil(F.col("early") / BLOCK).alias("ne"), F.ceil(F.col("late") / BLOCK).alias("nl")), "similar-long-lists")
    rows = joins.keep_matching(long.select("key", F.col("a").alias("cls"), F.col("x").alias("n"), F.col("y").alias("pos"), "tag"), sizes, ["key"], "inner")
    own = F.pmod(F.xxhash64("cls"), F.when(late, F.col("nl")).otherwise(F.col("ne")))
    rows = rows.withColumn("own", own).withColumn("late", late)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    pair = lambda x, y: F.struct(x.alias("low"), y.alias("high"))
    with_early = F.transform(upto(F.col("ne")), lambda e: pair(F.least("own", e), F.greatest("own", e)))
    with_late = F.transform(upto(F.col("nl")), lambda k: pair(F.col("own"), F.col("ne") + k))
    as_late = F.transform(upto(F.col("ne")), lambda e: pair(e, F.col("ne") + F.col("own")))
    rows = rows.withColumn("g", F.explode(F.when(F.col("late"), as_late).otherwise(F.concat(with_early, with_late))))
    block = F.when(F.col("late"), F.col("g.high")).otherwise(F.col("own"))
    tag = F.col("tag").bitwiseOR(F.shiftleft(block, 2)).bitwiseOR(F.when(F.col("g.low") != F.col("g.high"), F.lit(1 << _OTHER)).otherwise(F.lit(0).cast("long")))
    return rows.select(F.xxhash64("key", "g.low", "g.high").alias("key"), "cls", "n", "pos", tag.alias("tag"))


def _candidates(postings: DataFrame, measure: Measure) -> DataFrame:
    """Distinct pairs of classes (a < b) that share enough retained values and pass the size and position bounds."""
    short = scratch.materialize(_lists(postings, measure, ["key"], whole=False), "similar-lists")
    long = short.filter("tag >= 0")
    found = short.filter("tag = -1")
    if not long.isEmpty():
        found = found.unionByName(_lists(_split_lists(long), measure, ["key"], whole=True))
    return found.groupBy("a", "b").agg(F.sum("x").alias("shared"), F.min("y").alias("least")).filter("shared >= least").select("a", "b")


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of packed numbers as one flat array, and how many each row has."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw.tobytes(), kind), np.diff(at) // width


def _compared(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of pairs, cut so that no more than COMPARED values (or one pair) are looked at together."""
    for batch in stream:
        sizes = sum(pa.compute.binary_length(batches.column(batch, c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy") // 8
        part = np.cumsum(sizes) // COMPARED
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def _estimated(pairs: DataFrame, sketches: DataFrame, measure: Measure) -> DataFrame:
    """Pairs that their union sketch does not rule out.

    The union sketch is the SKETCH lowest values of both sketches together.
    With fewer values than that both sketches hold their whole sets, and the
    estimate is the similarity itself.
    """
    least = measure.least_sketch_hits()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _compared(stream):
            sides = [_numbers(batches.column(batch, c), np.uint32) for c in "xy"]
            owner = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for _, n in sides]).astype(np.uint64)
            both = np.sort((owner << np.uint64(32)) | np.concatenate([v for v, _ in sides]))
            twice = np.r_[False, both[1:] == both[:-1]]
            pair = (both >> np.uint64(32)).astype(np.int64)
            shared = np.bincount(pair[twice], minlength=batch.num_rows)
            union = np.bincount(pair, minlength=batch.num_rows) - shared
            # the rank of a value in its pair's union; the values above the union sketch don't count
            new = np.cumsum(~twice)
            rank = new - np.r_[0, np.cumsum(union)][pair] - 1
            hits = np.bincount(pair[twice & (rank < SKETCH)], minlength=batch.num_rows)
            keep = np.where(union < SKETCH, shared >= measure.threshold * union - 1e-9, hits >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(
        sketches.select(F.col("cls").alias("a"), F.col("sketch").alias("x")), "a",
    ).join(sketches.select(F.col("cls").alias("b"), F.col("sketch").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Pairs with their exact Jaccard similarity, of those that reach the threshold."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _compared(stream):
            sides = [_numbers(batches.column(batch, c), np.uint64) for c in "xy"]
            owner = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for _, n in sides])
            values = np.concatenate([v for v, _ in sides])
            order = np.lexsort((values, owner))
            values, owner = values[order], owner[order]
            twice = np.flatnonzero((values[1:] == values[:-1]) & (owner[1:] == owner[:-1]))
            overlap = np.bincount(owner[twice], minlength=batch.num_rows)
            union = sides[0][1] + sides[1][1] - overlap
            good = overlap >= measure.threshold * union - 1e-9
            yield pa.RecordBatch.from_arrays(
                [batches.column(batch, "a"), batches.column(batch, "b"), pa.array(overlap / np.maximum(union, 1))],
                names=["a", "b", "jaccard"],
            ).filter(pa.array(good))

    joined = pairs.join(
        sets.select(F.col("cls").alias("a"), F.col("values").alias("x")), "a",
    ).join(sets.select(F.col("cls").alias("b"), F.col("values").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, jaccard double")


def _class_sets(classes: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """The whole value sets of the classes named in `wanted` (cls)."""

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        values, offsets = value_sets(texts, batches.column(batch, "part").to_numpy(zero_copy_only=False), measure)
        return pa.RecordBatch.from_arrays([batches.column(batch, "cls"), _binaries(values, offsets[:-1], offsets[1:])], names=["cls", "values"])

    chosen = joins.keep_matching(classes.select("cls", "part", "text"), wanted, ["cls"])
    return batches.map_portions(chosen, "cls long, values binary", work)


@dataclass(frozen=True)
class Matches:
    """`members`: part, record, owner, role, cls, n, one row per record with enough words; `links`: pairs of classes a < b with their jaccard."""

    members: DataFrame
    links: DataFrame


def similar(records: DataFrame, measure: Measure) -> Matches:
    """All similar pairs among records, as links between classes of equal sets and the members of the classes.

    `records` has part (int, only records of one part are compared), record and
    owner (string), role (int 1 to 3) and text.  Null and short texts belong to
    no class; repeated rows are one member.  Both results are written tables.
    """
    records = records.select("part", "record", "owner", "role", "text").filter("text is not null").withColumn("th", F.xxhash64("text"))
    members = scratch.materialize(_members(records, measure), "similar-members")
    classes = scratch.materialize(_classes(records, members), "similar-classes")
    bits = _slot_bits(classes)
    summaries = scratch.materialize(_summaries(classes, measure, bits), "similar-sketches")
    order = _order(classes, summaries, measure, bits)
    pairs = scratch.materialize(_candidates(_postings(classes, order, measure), measure), "similar-pairs")
    named = scratch.materialize(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "similar-named")
    sketches = joins.keep_matching(summaries.filter("tag = 0").select("cls", "sketch"), named, ["cls"])
    likely = scratch.materialize(_estimated(pairs, scratch.materialize(sketches, "similar-named-sketches"), measure), "similar-likely")
    wanted = scratch.materialize(likely.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "similar-wanted")
    sets = scratch.materialize(_class_sets(classes, wanted, measure), "similar-exact")
    links = scratch.materialize(_exact(likely, sets, measure), "similar-links")
    return Matches(members.select("part", "record", "owner", "role", "cls", "n").distinct(), links)


def record_pairs(matches: Matches, part: int | None = None, other_owner: bool = False) -> DataFrame:
    """Pairs of records (part, record_a < record_b) that the links and the classes stand for.

    Copies are written out into pairs here; this is for results whose form demands it.
    """
    members = matches.members if part is None else matches.members.filter(F.col("part") == part)
    narrow = members.select("part", "record", "owner", "role", "cls")
    side = lambda s: narrow.select(
        F.col("cls").alias(f"c{s}"), F.col("part").alias(f"part{s}"), F.col("record").alias(f"r{s}"), F.col("owner").alias(f"o{s}"),
        F.col("role").alias(f"role{s}"),
    )
    several = narrow.groupBy("cls").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    links = matches.links.select("a", "b").unionByName(several)
    joined = links.join(side("1"), F.col("a") == F.col("c1")).join(side("2"), F.col("b") == F.col("c2"))
    joined = joined.filter((F.col("a") != F.col("b")) | (F.col("r1") < F.col("r2"))).filter(F.col("r1") != F.col("r2"))
    if other_owner:
        joined = joined.filter(~F.col("o1").eqNullSafe(F.col("o2")))
    first = F.col("r1") < F.col("r2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return joined.select(
        F.col("part1").alias("part"),
        pick("r1", "r2").alias("record_a"), pick("r2", "r1").alias("record_b"),
        pick("role1", "role2").alias("role_a"), pick("role2", "role1").alias("role_b"),
    ).distinct()
