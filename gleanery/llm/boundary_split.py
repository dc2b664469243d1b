"""Cutting oversized texts at natural boundaries, and judging cuts that others made (problem 4).

Both directions follow one notion of a boundary, stated once in `Barriers`: a
position may not be cut inside a run of letters and digits (kana and kanji
excepted) or inside a fenced code block, unless the run or block is itself
longer than the limit.  All other positions have a strength: paragraph, line,
sentence, clause, blank, none.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery import joins, scratch
from gleanery.llm import batches, textcodes

PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, PLAIN = 6, 5, 4, 3, 2, 1
_FENCE = re.compile(r"^```.*?^```[^\n]*", re.M | re.S)
_STRENGTHS = (
    (BLANK, re.compile(r"\s+")),
    (CLAUSE, re.compile(r"[,;:)\]]\s+|[、，；：]")),
    (SENTENCE, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]+[」』）]*")),
    (LINE, re.compile(r"\n+")),
    (PARAGRAPH, re.compile(r"\n\s*\n+|\n(?=#{1,6} )")),
)
#: Ordinals of one document that are put in sequence together; longer sequences go by way of their groups' last chunks.
ORDINALS = 1024
#: Chunks of one document that are judged together; the document comes again for each further group of so many.
JUDGED = 50_000


def fences(text: str | None) -> list[tuple[int, int]]:
    """Spans of fenced code blocks: from a line that begins with three backticks through the next such line."""
    return [m.span() for m in _FENCE.finditer(text)] if text and "```" in text else []


@dataclass(frozen=True)
class Barriers:
    """Stretches (starts, ends) of one text that may not be cut while they are within the limit: runs of letters and digits, and fenced blocks."""

    size: int
    runs: tuple[np.ndarray, np.ndarray]
    blocks: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, text: str, codes: np.ndarray) -> "Barriers":
        letter = textcodes.word_classes()[codes] == textcodes.LETTER
        edges = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
        blocks = np.array(fences(text), np.int64).reshape(-1, 2)
        return cls(len(text), (edges[::2], edges[1::2]), (blocks[:, 0], blocks[:, 1]))

    def inside(self, limit: int) -> np.ndarray:
        """Whether each position 0 .. size lies strictly inside a stretch of at most `limit`."""
        steps = np.zeros(self.size + 2, np.int32)
        for starts, ends in (self.runs, self.blocks):
            some = ends - starts <= limit
            np.add.at(steps, starts[some] + 1, 1)
            np.subtract.at(steps, ends[some], 1)
        return np.cumsum(steps)[:-1] > 0

    @staticmethod
    def parted(stretches: tuple[np.ndarray, np.ndarray], at: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Whether a cut at each position parts a stretch of at most the limit given for it."""
        starts, ends = stretches
        if not len(starts):
            return np.zeros(len(at), bool)
        k = np.searchsorted(starts, at) - 1  # the last one that begins before
        return (k >= 0) & (at < ends[k]) & (ends[k] - starts[k] <= limits)


def cut_strengths(text: str, limit: int) -> np.ndarray:
    """The strength of a cut at each position 0 .. len(text); 0 where no cut is allowed."""
    out = np.full(len(text) + 1, PLAIN, np.uint8)
    for strength, pattern in _STRENGTHS:
        out[[m.end() for m in pattern.finditer(text)]] = strength
    codes, _ = textcodes.flat_codes([text])
    marks = np.flatnonzero(textcodes.word_classes()[codes] == textcodes.MARK)  # a mark stays with its letter
    out[marks[out[marks] == PLAIN]] = 0
    out[Barriers.of(text, codes).inside(limit)] = 0
    return out


def bisect(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (start, end) of pieces of at most `limit` code points that cover the text.

    A span over limit - overlap is cut at the strongest boundary of its middle
    half (the one nearest the middle among equals), else at the allowed
    position nearest the middle, and both halves are treated alike.  A span without an allowed
    cut stays whole if it is within the limit.  Afterwards each piece but the
    first is extended to the left by up to `overlap` code points, to the
    strongest boundary there, as far as the limit allows.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("need 0 <= overlap < limit")
    if len(text) <= limit:
        return [(0, len(text))]
    strengths = cut_strengths(text, limit)
    cores: list[tuple[int, int]] = []
    open_spans = [(0, len(text))]
    while open_spans:
        a, b = open_spans.pop()
        if b - a <= limit - overlap:
            cores.append((a, b))
            continue
        quarter, middle = (b - a) // 4, (a + b) // 2
        low, high = a + max(quarter, 1), b - max(quarter, 1)
        inner = strengths[low : high + 1].astype(np.int64)
        if not inner.any():
            low, high = a + 1, b - 1
            inner = (strengths[low : high + 1] > 0).astype(np.int64)
        if inner.any():
            best = low + np.flatnonzero(inner == inner.max())
            cut = int(best[np.argmin(np.abs(best - middle))])
        elif b - a <= limit:
            cores.append((a, b))
            continue
        else:  # can't be: runs and blocks over the limit may be cut
            cut = middle
        open_spans += [(cut, b), (a, cut)]
    pieces = []
    for n, (a, b) in enumerate(cores):
        reach = max(a - min(overlap, limit - (b - a)), 0)
        if n and reach < a:
            back = strengths[reach:a].astype(np.int64)
            if back.any():
                a = reach + int(np.argmax(back))
        pieces.append((a, b))
    return pieces


def split_oversized(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: str = "max_chars", overlap: str = "overlap_chars",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, the columns of `keep`, piece, char_start, char_end, text for each text longer than its row's limit.

    The limits are columns of `docs`.  Texts within the limit, null texts and
    rows whose limits are null or senseless (limit < 1, overlap < 0 or >=
    limit) give no pieces.  No shuffle; rows sent again are split again.
    """
    wanted = docs.select(
        F.col(key).alias("doc_id"), *keep, F.col(text).alias("text"), F.col(limit).cast("int").alias("most"),
        F.col(overlap).cast("int").alias("shared"),
    )
    wanted = wanted.filter("most >= 1 and shared >= 0 and shared < most and length(text) > most")
    kept = [wanted.schema[c] for c in ("doc_id", *keep)]

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        rows = [(i, n, a, b, t[a:b]) for i, (t, most, shared) in enumerate(zip(texts, batches.column(batch, "most").to_pylist(), batches.column(batch, "shared").to_pylist())) for n, (a, b) in enumerate(bisect(t, most, shared))]
        at, n, a, b, piece = zip(*rows)
        same = [batches.column(batch, f.name).take(pa.array(at)) for f in kept]
        return pa.RecordBatch.from_arrays(
            [*same, *(pa.array(x, pa.int32()) for x in (n, a, b)), pa.array(piece, pa.string())],
            names=[*(f.name for f in kept), "piece", "char_start", "char_end", "text"],
        )

    schema = T.StructType([*kept, *(T.StructField(c, T.IntegerType()) for c in ("piece", "char_start", "char_end")), T.StructField("text", T.StringType())])
    return batches.map_portions(wanted, schema, work)


def _previous_ends(rows: DataFrame) -> DataFrame:
    """`rows` with prev_end: the char_end of the document's previous chunk by ordinal, 0 for the first.

    A window over a document takes at most ORDINALS consecutive ordinals; what
    precedes such a group is the last chunk of the group before.
    """
    rows = rows.withColumn("part", F.floor(F.coalesce("ordinal", F.lit(0)) / ORDINALS))
    groups = rows.groupBy("doc_id", "chunk_set_id", "part").agg(F.max(F.struct("ordinal", "chunk_id", "char_end")).alias("last"))
    groups = groups.select(
        "doc_id", "chunk_set_id", "part",
        F.lag("last.char_end").over(Window.partitionBy("doc_id", "chunk_set_id").orderBy("part")).alias("before"),
    )
    own = F.lag("char_end").over(Window.partitionBy("doc_id", "chunk_set_id", "part").orderBy("ordinal", "chunk_id"))
    first = F.row_number().over(Window.partitionBy("doc_id", "chunk_set_id", "part").orderBy("ordinal", "chunk_id")) == 1
    rows = rows.withColumn("own_end", own).withColumn("opens", first)
    same = [rows["doc_id"] == groups["doc_id"], rows["chunk_set_id"].eqNullSafe(groups["chunk_set_id"]), rows["part"] == groups["part"]]
    joined = rows.join(groups, same, "left").select(*(rows[c] for c in rows.columns), groups["before"])
    return joined.withColumn(
        "prev_end", F.coalesce(F.when(F.col("opens"), F.col("before")).otherwise(F.col("own_end")), F.lit(0)),
    ).drop("own_end", "opens", "before", "part")


_FAULTS = ("too_long", "altered", "in_word", "in_fence", "gap", "overlapping")
_ROW = ("chunk_id", "char_start", "char_end", "prev_end", "most", "shared", "digest")


def _judge(text: str | None, start: np.ndarray, end: np.ndarray, before: np.ndarray, most: np.ndarray, digests: list) -> list[np.ndarray]:
    """altered, in_word, in_fence, gap of the cuts of one text; a number below 0 stands for null."""
    none = np.zeros(len(start), bool)
    if text is None:
        return [none] * 4
    codes, _ = textcodes.flat_codes([text])
    barriers, size = Barriers.of(text, codes), len(text)
    whole = (start >= 0) & (end >= 0)
    altered = none.copy()
    for i in np.flatnonzero(whole).tolist():
        altered[i] = digests[i] is not None and hashlib.md5(text[start[i] : end[i]].encode("utf-8", "surrogatepass")).hexdigest() != digests[i]
    cut = lambda stretches: np.any([(p > 0) & (p < size) & barriers.parted(stretches, p, most) for p in (start, end)], axis=0)
    signs = np.zeros(size + 1, np.int64)
    np.cumsum(~np.isin(codes, textcodes.WHITE_SPACE), out=signs[1:])
    gap = (start > before) & (signs[np.clip(start, 0, size)] > signs[np.clip(before, 0, size)])
    return [altered, cut(barriers.runs), cut(barriers.blocks), gap]


def cut_faults(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id and one boolean for each fault of a chunk: too_long, altered, in_word, in_fence, gap, overlapping.

    The cuts of a document are judged together, in one pass over its text, by
    the same barriers that the bisection keeps to.  Chunks travel without their
    texts: a digest tells whether the text is the document's.  A condition that
    needs a null offset, parameter or text doesn't hold, nor does one with a
    negative offset; chunks of unknown documents can only be too long or
    overlapping.  Rows sent again are one chunk.
    """
    params = lambda name: F.expr(f"try_cast(chunker_params['{name}'] as int)")
    named = chunks.filter("chunk_id is not null")
    rows = named.select(
        "chunk_id", "doc_id", "chunk_set_id", "ordinal", "char_start", "char_end", params("max_chars").alias("most"),
        params("overlap_chars").alias("shared"), F.md5("text").alias("digest"),
    ).distinct()
    lost = rows.filter("doc_id is null").withColumn("prev_end", F.lit(None).cast("int"))
    rows = _previous_ends(rows.filter("doc_id is not null"))
    large = named.filter("doc_id is not null").groupBy("doc_id").agg(F.ceil(F.count("*") / JUDGED).alias("groups")).filter("groups > 1")
    large = scratch.materialize(large, "cuts-large")
    rows = rows.join(
        F.broadcast(large) if joins.is_small(large) else large, "doc_id", "left",
    ).withColumn("group", F.pmod(F.xxhash64("chunk_id"), F.coalesce("groups", F.lit(1))))
    cuts = rows.groupBy("doc_id", "group").agg(F.collect_list(F.struct(*_ROW)).alias("cuts")).drop("group")
    texts = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    too_long, overlapping = F.col("char_end") - F.col("char_start") > F.col("most"), F.col("prev_end") - F.col("char_start") > F.col("shared")

    def work(batch: pa.RecordBatch, whole: list) -> pa.RecordBatch:
        lists = batches.column(batch, "cuts")
        fields = lists.flatten().flatten()
        field = lambda name: fields[_ROW.index(name)]
        number = {name: pc.fill_null(field(name), -1).to_numpy(zero_copy_only=False).astype(np.int64) for name in _ROW[1:6]}
        digests = field("digest").to_pylist()
        found = np.zeros((4, len(fields[0])), bool)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        for text, a, b in zip(whole, np.r_[0, ends].tolist(), ends.tolist()):
            found[:, a:b] = _judge(text, *(number[name][a:b] for name in ("char_start", "char_end", "prev_end", "most")), digests[a:b])
        return pa.RecordBatch.from_arrays([*(field(n) for n in _ROW[:6]), *map(pa.array, found)], names=[*_ROW[:6], *_FAULTS[1:5]])

    schema = "chunk_id string, char_start int, char_end int, prev_end int, most int, shared int, altered boolean, in_word boolean, in_fence boolean, gap boolean"
    judged = batches.map_portions(cuts.join(texts, "doc_id", "left").select("text", "cuts"), schema, work)
    lost = lost.select(*_ROW[:6], *(F.lit(False).alias(c) for c in _FAULTS[1:5]))
    no = lambda c: F.coalesce(c, F.lit(False))
    return judged.unionByName(lost).select("chunk_id", no(too_long).alias("too_long"), *_FAULTS[1:5], no(overlapping).alias("overlapping"))


def faulty_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id of the chunks that have any fault."""
    return cut_faults(docs, chunks).filter(" or ".join(_FAULTS)).select("chunk_id").distinct()


def piece_checks(limited: DataFrame) -> DataFrame:
    """doc_id, chunk_set_id, n_chars, first_start, last_end, faults: for each text over its limit how far its pieces reach and how many of them have a fault.

    `limited` are documents with limits (see `with_limits`); the pieces are judged
    like chunks that others cut.  A right result reaches from 0 to n_chars and
    has no fault.
    """
    names = ("chunk_set_id", "max_chars", "overlap_chars")
    pieces = scratch.materialize(split_oversized(limited, keep=names).withColumn("chunk_id", F.concat_ws("/", "doc_id", "chunk_set_id", "piece")), "pieces")
    params = F.create_map(*(x for c in names[1:] for x in (F.lit(c), F.col(c).cast("string"))))
    faults = cut_faults(
        limited, pieces.withColumn("ordinal", F.col("piece")).withColumn("chunker_params", params),
    ).filter(" or ".join(_FAULTS)).select("chunk_id").distinct().withColumn("bad", F.lit(1))
    reach = pieces.join(faults, "chunk_id", "left").groupBy("doc_id", "chunk_set_id").agg(
        F.min("char_start").alias("first_start"), F.max("char_end").alias("last_end"), F.count("bad").alias("faults"),
    )
    sizes = limited.filter("length(text) > max_chars").select("doc_id", "chunk_set_id", F.length("text").alias("n_chars"))
    return sizes.join(reach, ["doc_id", "chunk_set_id"], "left")


def with_limits(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the limits of their own chunk set: chunk_set_id, max_chars, overlap_chars."""
    sets = chunks.filter("doc_id is not null").groupBy("doc_id", "chunk_set_id").agg(*(F.max(F.expr(f"try_cast(chunker_params['{c}'] as int)")).alias(c) for c in ("max_chars", "overlap_chars")))
    return docs.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"]).join(sets, "doc_id")
