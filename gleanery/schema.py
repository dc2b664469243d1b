"""Schemas of the tables that the stages hand to one another."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*required: tuple, optional: tuple = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in required] + [T.StructField(n, t, True) for n, t in optional])


_META = T.MapType(_S, _S)
_NUMBERS = T.MapType(_S, _D)

DOCUMENT = _struct(("doc_id", _S), ("corpus", _S), ("source_path", _S), ("title", _S), ("text", _S), ("content_type", _S), ("meta", _META))
SPEC = _struct(("char_start", _I), ("char_end", _I), ("text", _S), ("heading_path", T.ArrayType(_S)), ("meta", _META), optional=(("embed_text", _S),))
CHUNK = _struct(
    ("chunk_id", _S), ("doc_id", _S), ("corpus", _S), ("chunk_set_id", _S), ("text", _S), ("embed_text", _S), ("char_start", _I), ("char_end", _I),
    ("token_count", _I), ("ordinal", _I), ("role", _S), ("heading_path", T.ArrayType(_S)), ("chunker", _S), ("chunker_params", _S), ("meta", _META),
    optional=(("parent_id", _S),),
)
SPAN = T.StructType([T.StructField("start", _I, False), T.StructField("end", _I, False)])
EVAL_PAIR = _struct(
    ("query_id", _S), ("corpus", _S), ("query", _S), ("gold_doc_id", _S), ("gold_char_spans", T.ArrayType(T.ArrayType(_I))), ("sampling_chunk_ids", T.ArrayType(_S)),
    ("supporting_quotes", T.ArrayType(_S)), ("difficulty", _S), ("split", _S), ("generator_model", _S), ("validated", _B),
    optional=(("answer", _S),),
)
MANIFEST = _struct(
    ("index_id", _S), ("chunk_set_id", _S), ("corpus", _S), ("embedder", _S), ("embedder_params", _S), ("vector_count", _I), ("dim", _I),
    ("build_duration_s", _D), ("library_versions", _META), ("schema_version", _S), ("created_at", T.TimestampType()),
)
VECTOR = _struct(("chunk_id", _S), ("doc_id", _S), ("corpus", _S), ("chunk_set_id", _S), ("chunker", _S), ("embedding", T.ArrayType(T.FloatType())))
SCORED = _struct(("query_id", _S), ("chunk_id", _S), ("score", _D), ("rank", _I), ("retriever", _S))
TRACE = _struct(
    ("query_id", _S), ("query", _S), ("retrieved_chunk_ids", T.ArrayType(_S)), ("retrieved_scores", T.ArrayType(_D)), ("gold_chunk_ids", T.ArrayType(_S)),
    ("metrics", _NUMBERS), ("excluded", _B),
    optional=(("first_hit_rank", _I), ("exclusion_reason", _S)),
)
SCHEMA_VERSION = "1"
CONTENT_TYPES = ("markdown", "text", "html")
ROLES = ("standalone", "parent", "child")
DIFFICULTIES = ("lookup", "synthesis", "cross_reference")
