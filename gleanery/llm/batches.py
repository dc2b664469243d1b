"""Arrow batches in and out of Python, in portions of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that one portion holds at most, unless a single text is longer; bounds a worker's memory.
PORTION_BYTES = 1_500_000


def portions(batches: Iterable[pa.RecordBatch], text_column: str = "text", limit: int = PORTION_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut record batches into runs of whole rows whose texts have at most `limit` bytes together.

    A text is never cut: one that is longer than the limit makes a portion of its own.
    """
    for batch in batches:
        # sizes come from Arrow, so that only one portion's strings exist at a time; bytes are at least as many as characters
        sizes = pc.fill_null(pc.binary_length(column(batch, text_column)), 0).to_pylist()
        begin = size = 0
        for i, n in enumerate([*sizes, limit]):
            if i > begin and (i == len(sizes) or size + n > limit):
                part = batch.slice(begin, i - begin)
                yield part, column(part, text_column).to_pylist()
                begin, size = i, 0
            size += n


def map_portions(df: DataFrame, schema: T.StructType | str, work: Callable[[pa.RecordBatch, list], pa.RecordBatch | None], text_column: str = "text") -> DataFrame:
    """mapInArrow over portions; `work` gets a portion and its texts and returns a batch of the schema."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, text_column):
            out = work(batch, texts)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
