"""Joins whose small side is broadcast only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a broadcast side may have; beyond it the join is left to shuffle.
BROADCAST_BYTES = 8_000_000


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about as they lie in an unsafe row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        fields = len(kind.elementType.fields) + 2 if isinstance(kind.elementType, T.StructType) else 1
        return F.greatest(F.size(column), F.lit(0)) * (8 * fields) + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2 + 32
    return F.lit(8)


def byte_size(df: DataFrame) -> int:
    """Bytes of all rows, counted where they are; only the sum comes to the driver."""
    widths = [_width(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields]
    return df.agg(F.sum(sum(widths, F.lit(16).cast("long")))).first()[0] or 0


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether a (written or cheap) frame has at most `limit` bytes."""
    return byte_size(df) <= (BROADCAST_BYTES if limit is None else limit)


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", limit: int | None = None) -> DataFrame:
    """Join `df` with the narrow frame `keys`: broadcast where that is proven small, by shuffle otherwise."""
    return df.join(F.broadcast(keys) if is_small(keys, limit) else keys.hint("shuffle_merge"), on, how)
