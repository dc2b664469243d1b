"""Long spans that stand verbatim in more than one document (problem 8).

Windows of `length` code points are never shipped one by one.  Consecutive
windows that share a minimiser (the least hash of the k-signs-long pieces in the
window) travel as one packed string, a super-k-mer, to the minimiser's bucket.
Two equal windows have the same minimiser, so a window that is shared is always
found in one bucket, where the windows' hashes are sorted.  A match is confirmed
by the texts themselves for pairs, and by a second, independent 64-bit hash for
coverage.

Buckets that only one document feeds can't hold a shared window.  A first pass
therefore ships only (minimiser, document) to count documents per bucket
exactly, and the last packs strings for the other buckets alone.

A bucket of many documents is first told apart by a second, longer minimiser
(nine tenths of a window), counted the same way: documents that merely have a
stock phrase in common fall apart there.  What is still a large bucket holds
documents that share nearly whole windows.  No string is packed for it: each of
its few windows (a tenth of a window's length at most for each super-k-mer) is a
row of two hashes, the document and the place, and equal windows are one class,
put together before they are shuffled.  So the work grows with the number of
documents, not with its square; only written pairs are as many as there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import joins, scratch
from gleanery.llm import batches, textcodes

#: Signs in a minimiser; long enough that stock phrases alone rarely make one.
MINIMISER = 100
#: Documents of a bucket that is sorted as a whole; larger ones are taken apart.
BLOCK = 500
#: Documents of one class of windows that are paired in one task group.
PAIRED = 2000
#: Makes the second hash of a window independent of the first.
_SECOND = np.uint64(0xA24BAED4963EE407)


def _least(codes: np.ndarray, length: int, k: int) -> np.ndarray:
    """The least hash of the pieces of k signs in each window."""
    starts = np.arange(len(codes) - k + 1)
    return textcodes.sliding_minimum(textcodes.span_hashes(textcodes.code_values()[codes], starts, starts + k), length - k + 1)


def buckets(texts: list, length: int, k: int, large: list | None = None, both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each super-k-mer: text number, first window, number of windows, bucket.

    The bucket is the minimiser; for minimisers named in `large` (one list for each
    text) it is made of that and the longer minimiser.  With `both` false only
    these are given.
    """
    codes, offsets = textcodes.flat_codes([x or "" for x in texts])
    empty = np.zeros(0, np.int64)
    if len(codes) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    value = _least(codes, length, k)
    at = np.flatnonzero(owner[: len(value)] == owner[length - 1 :])  # windows within one text
    value = value[at]
    named = np.unique(np.array([b for row in large or () for b in row or ()], np.int64)).view(np.uint64)
    if len(named):
        split = np.isin(value, named)
        second = _least(codes, length, max(k, length * 9 // 10))[at]
        value = np.where(split, textcodes.mix(value + second * _SECOND), value)
        if not both:
            at, value = at[split], value[split]
    elif not both:
        return empty, empty, empty, np.zeros(0, np.uint64)
    if not len(at):
        return empty, empty, empty, np.zeros(0, np.uint64)
    text = owner[at]
    first = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
    counts = np.diff(np.r_[first, len(at)])
    return text[first], at[first] - offsets[text[first]], counts, value[first]


def _bucket_rows(documents: DataFrame, length: int, k: int, second: bool = False) -> DataFrame:
    """bucket, doc: each bucket of a document once; with `second` those that the column `large` is told apart into."""

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        large = batches.column(batch, "large").to_pylist() if second else None
        text, _, _, value = buckets(texts, length, k, large, not second)
        rows = np.unique(np.stack([text.astype(np.uint64), value]), axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[1].view(np.int64)), batches.column(batch, "doc").take(pa.array(rows[0].astype(np.int64)))],
            names=["bucket", "doc"],
        )

    kind = documents.schema["doc"].dataType
    return batches.map_portions(documents, T.StructType([T.StructField("bucket", T.LongType()), T.StructField("doc", kind)]), work)


def _chosen(batch: pa.RecordBatch, texts: list, length: int, k: int, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, count, bucket of the super-k-mers whose bucket the row's list `column` names."""
    text, start, count, value = buckets(texts, length, k, batches.column(batch, "large").to_pylist())
    lists = batches.column(batch, column)
    owner = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
    # two pairs of text and bucket that mix to one number only ship a string too many
    number = lambda t, v: textcodes.mix(v + textcodes.mix(t.astype(np.uint64)) * _SECOND)
    some = np.isin(number(text, value), number(owner, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)))
    return text[some], start[some], count[some], value[some]


def _packed(documents: DataFrame, length: int, k: int) -> DataFrame:
    """The super-k-mers of the buckets in the column `packs`, each once: bucket, doc, start, piece."""

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        text, start, count, value = _chosen(batch, texts, length, k, "packs")
        pieces = [texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), (start + count + length - 1).tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), batches.column(batch, "doc").take(pa.array(text)), pa.array(start), pa.array(pieces, pa.string())],
            names=["bucket", "doc", "start", "piece"],
        )

    kind = documents.schema["doc"].dataType
    fields = [("bucket", T.LongType()), ("doc", kind), ("start", T.LongType()), ("piece", T.StringType())]
    return batches.map_portions(documents, T.StructType([T.StructField(n, t) for n, t in fields]), work)


def _window_rows(documents: DataFrame, length: int, k: int) -> DataFrame:
    """The windows of the buckets in the column `hot`: two hashes, doc, at."""

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        text, start, count, _ = _chosen(batch, texts, length, k, "hot")
        codes, offsets = textcodes.flat_codes([x or "" for x in texts])
        at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        text = np.repeat(text, count)
        begin = offsets[text] + at
        hashes = [textcodes.span_hashes(v, begin, begin + length).view(np.int64) for v in _values(codes)]
        return pa.RecordBatch.from_arrays([*map(pa.array, hashes), batches.column(batch, "doc").take(pa.array(text)), pa.array(at)], names=["h", "g", "doc", "at"])

    kind = documents.schema["doc"].dataType
    fields = [("h", T.LongType()), ("g", T.LongType()), ("doc", kind), ("at", T.LongType())]
    return batches.map_portions(documents, T.StructType([T.StructField(n, t) for n, t in fields]), work)


def _values(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the signs for the first and for the second hash of a window."""
    one = textcodes.code_values()[codes]
    return one, textcodes.mix(one ^ _SECOND)


def _shared_windows(groups: np.ndarray, docs: np.ndarray, pieces: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole groups: for each window that several documents have, its members, as (window, piece, offset, document) arrays."""
    codes, offsets = textcodes.flat_codes(pieces)
    counts = np.diff(offsets) - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = groups[piece]
    for value in _values(codes):  # the second hash tells apart what the first one takes for equal
        starts = offsets[:-1][piece] + at
        hashes = textcodes.span_hashes(value, starts, starts + length)
        order = np.lexsort((at, docs[piece], hashes, window))
        piece, at, hashes, window = piece[order], at[order], hashes[order], window[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (window[1:] != window[:-1])] if len(piece) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(piece)])
        several = np.repeat(docs[piece[first]] != docs[piece[first + sizes - 1]], sizes)
        piece, at, window = piece[several], at[several], (np.cumsum(new) - 1)[several]
    return window, piece, at, docs[piece]


def _streamed(packed: DataFrame, length: int, fields: str, work) -> DataFrame:
    """Sort the packed strings into their buckets and hand whole groups, many at a time, to `work`."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in stream:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            group = _group_numbers(rest)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield from _portions(rest.slice(0, last), group[:last])
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield from _portions(rest, _group_numbers(rest))

    def _portions(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.fromiter(map(len, pieces := table["piece"].to_pylist()), np.int64, table.num_rows)
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends, begin, total = np.r_[cuts[1:], len(group)], 0, np.r_[0, np.cumsum(sizes)]
        for k, end in enumerate(ends.tolist()):
            if total[end] - total[begin] > batches.PORTION_BYTES // 4 or k == len(ends) - 1:
                out = work(table.slice(begin, end - begin), group[begin:end], pieces[begin:end])
                if out is not None and out.num_rows:
                    yield out
                begin = end

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, fields)


def _group_numbers(table: pa.Table) -> np.ndarray:
    bucket = table["bucket"].to_numpy()
    return np.cumsum(np.r_[False, bucket[1:] != bucket[:-1]])


def _pair_rows(packed: DataFrame, length: int) -> DataFrame:
    """a, b: pairs of documents that have a window in common."""
    kind = packed.schema["doc"].dataType.simpleString()

    def work(table: pa.Table, group: np.ndarray, pieces: list[str]) -> pa.RecordBatch | None:
        names = pa.compute.unique(table["doc"].combine_chunks())
        docs = pa.compute.index_in(table["doc"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
        window, piece, at, doc = _shared_windows(group, docs, pieces, length)
        if not len(window):
            return None
        new = np.r_[True, (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])]
        window, piece, at, doc = window[new], piece[new], at[new], doc[new]
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        ends = np.r_[first[1:], len(window)]
        # windows next to each other mostly have the same documents; each set of documents is written out once
        marks = textcodes.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        total = np.r_[np.uint64(0), np.cumsum(marks, dtype=np.uint64)]
        _, chosen = np.unique(np.stack([(total[ends] - total[first]), group[piece[first]].astype(np.uint64)]), axis=1, return_index=True)
        out: list[np.ndarray] = []
        for w in chosen.tolist():
            a, b = first[w], ends[w]
            texts: dict[str, list[int]] = {}  # leave no match to chance: the texts of the windows decide
            for i in range(a, b):
                texts.setdefault(pieces[piece[i]][at[i] : at[i] + length], []).append(i)
            for same in texts.values():
                members = doc[same]
                one, two = np.triu_indices(len(members), 1)
                out.append(np.stack([members[one], members[two]]))
        if not out:
            return None
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([names.take(pa.array(found[0])), names.take(pa.array(found[1]))], names=["a", "b"])

    return _streamed(packed, length, f"a {kind}, b {kind}", work)


def _span_rows(packed: DataFrame, length: int) -> DataFrame:
    """doc, span_start, span_end: runs of shared windows, as code points of the document."""
    kind = packed.schema["doc"].dataType.simpleString()

    def work(table: pa.Table, group: np.ndarray, pieces: list[str]) -> pa.RecordBatch | None:
        names = pa.compute.unique(table["doc"].combine_chunks())
        docs = pa.compute.index_in(table["doc"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
        _, piece, at, _ = _shared_windows(group, docs, pieces, length)
        if not len(piece):
            return None
        order = np.lexsort((at, piece))
        piece, at = piece[order], at[order]
        first = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)])
        last = np.r_[first[1:] - 1, len(piece) - 1]
        base = table["start"].to_numpy()[piece[first]]
        return pa.RecordBatch.from_arrays(
            [table["doc"].combine_chunks().take(pa.array(piece[first])), pa.array(base + at[first]), pa.array(base + at[last] + length)],
            names=["doc", "span_start", "span_end"],
        )

    return _streamed(packed, length, f"doc {kind}, span_start long, span_end long", work)


def _candidates(documents: DataFrame, length: int, k: int, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """The packed strings of ordinary buckets, and the written windows of those that stay large, if any do."""
    if not 0 < k <= length:
        raise ValueError("the minimiser must be at most as long as the window")
    source = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= length))
    of = lambda column, test: F.transform(F.filter(column, test), lambda x: x["bucket"])
    few, many = (lambda x: x["docs"] <= BLOCK), (lambda x: x["docs"] > BLOCK)
    none = F.array().cast("array<long>")
    rows = scratch.materialize(_bucket_rows(source, length, k), "minimisers")
    wanted = scratch.materialize(
        _per_document(rows).select("doc", of("buckets", few).alias("packs"), of("buckets", many).alias("large"), none.alias("hot")),
        "wanted",
    )
    large = wanted.filter("size(large) > 0").select("doc", "large")
    if not large.isEmpty():
        again = scratch.materialize(_bucket_rows(joins.keep_matching(source, large, ["doc"], "inner"), length, k, second=True), "longer-minimisers")
        more = _per_document(again).select("doc", of("buckets", few).alias("more"), of("buckets", many).alias("hotter"))
        wanted = wanted.join(more, "doc", "left").select(
            "doc", F.concat("packs", F.coalesce("more", none)).alias("packs"), "large", F.coalesce("hotter", none).alias("hot"),
        )
        wanted = scratch.materialize(wanted, "wanted-buckets")
    packs = wanted.filter("size(packs) > 0").drop("hot")
    packed = _packed(joins.keep_matching(source, packs, ["doc"], "inner"), length, k)
    hot = wanted.filter("size(hot) > 0").select("doc", "large", "hot")
    if hot.isEmpty():
        return packed, None
    return packed, scratch.materialize(_window_rows(joins.keep_matching(source, hot, ["doc"], "inner"), length, k).distinct(), "windows")


def _class_pairs(windows: DataFrame) -> DataFrame:
    """a, b: pairs of documents that have a window of a large bucket in common.

    Classes of windows with the same documents are one; the documents of a class
    are split into blocks, and each pair of blocks is joined by itself.
    """
    rows = windows.select("h", "g", "doc").distinct()
    sets = rows.groupBy("h", "g").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"),
    ).filter("n > 1")
    one = sets.groupBy("n", "x", "y").agg(F.min(F.struct("h", "g")).alias("w")).select("w.h", "w.g", F.ceil(F.col("n") / PAIRED).alias("blocks"))
    one = scratch.materialize(one, "window-classes")
    members = joins.keep_matching(rows, one, ["h", "g"], "inner").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = members.select("h", "g", F.col("doc").alias("a"), F.col("own").alias("p"), others.alias("q"))
    right = members.select("h", "g", F.col("doc").alias("b"), F.col("own").alias("q"), others.alias("p"))
    return left.join(right, ["h", "g", "p", "q"]).filter("a < b").select("a", "b")


def _class_spans(windows: DataFrame, length: int) -> DataFrame:
    """doc, span_start, span_end: the windows of large buckets that several documents have."""
    shared = windows.groupBy("h", "g").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low != high").select("h", "g")
    kept = joins.keep_matching(windows, scratch.materialize(shared, "window-classes"), ["h", "g"])
    return kept.select("doc", F.col("at").alias("span_start"), (F.col("at") + length).alias("span_end"))


def _per_document(rows: DataFrame) -> DataFrame:
    """doc, buckets (bucket, docs): the buckets that at least two documents feed, for each document that feeds any; as many as its text has."""
    rows = rows.distinct()  # rows of one document that came twice
    shared = rows.groupBy("bucket").agg(F.count("*").alias("docs")).filter("docs > 1")
    return rows.join(shared, "bucket").groupBy("doc").agg(F.collect_list(F.struct("bucket", "docs")).alias("buckets"))


def shared_pairs(documents: DataFrame, length: int = 320, k: int = MINIMISER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id_a < doc_id_b: documents whose texts have at least `length` consecutive code points in common.

    Null and shorter texts share nothing, rows without a key are left out, and
    rows of one key are one document.
    """
    packed, windows = _candidates(documents, length, k, key, text)
    found = _pair_rows(packed, length)
    if windows is not None:
        found = found.unionByName(_class_pairs(windows))
    return found.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def shared_coverage(documents: DataFrame, length: int = 320, k: int = MINIMISER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, n_spans, shared_chars, shared_fraction: how much of each document stands elsewhere too.

    One row for each distinct key; a null or empty text has 0 of 0 characters
    and the fraction 0.  Spans that overlap or touch count once.
    """
    packed, windows = _candidates(documents, length, k, key, text)
    found = _span_rows(packed, length)
    if windows is not None:
        found = found.unionByName(_class_spans(windows, length))
    found = found.distinct()
    w = "partition by doc order by span_start, span_end"
    spans = found.selectExpr("*", f"max(span_end) over ({w} rows between unbounded preceding and 1 preceding) as reach")
    spans = spans.selectExpr(
        "doc", "cast(reach is null or span_start > reach as int) as opens",
        "greatest(span_end - greatest(span_start, coalesce(reach, span_start)), 0) as adds",
    )
    sums = spans.groupBy("doc").agg(F.sum("opens").alias("n_spans"), F.sum("adds").alias("shared_chars"))
    base = documents.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    out = base.join(sums, "doc", "left").select(
        F.col("doc").alias("doc_id"), "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
    )
    return out.withColumn("shared_fraction", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
