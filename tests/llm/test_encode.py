import base64
import functools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from gleanery.functions.tokens import BPE_WORDS
from gleanery.llm import encode

tiktoken = pytest.importorskip("tiktoken")
SIGNS = ["'", "'s", "'re", "'ll", "'v", "e", "re", " ", "  ", "\n", "\t", "　", "\xa0", "a", "Bee", "é", "日本", "12", "²", "_", "!?", "\x1c", "́", "😀", "aaaaaaaa", "<|endoftext|>"]


@functools.cache
def known_encoding():
    with open(encode.DEFAULT_VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("known", pat_str=BPE_WORDS, mergeable_ranks=ranks, special_tokens={})


def plain_ids(text):
    return known_encoding().encode_ordinary(text)


@pytest.fixture(scope="module")
def known():
    return known_encoding()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=12).map("".join), min_size=1, max_size=5))
def test_equals_a_known_encoder(known, texts):
    ids, offsets = encode.ByteBpe.load(encode.DEFAULT_VOCABULARY).encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == known.encode_ordinary(text)


def test_long_words_and_round_trip(known):
    texts = ["ab" * 50_000, "x" * 10_001, None, ""]
    ids, offsets = encode.ByteBpe.load(encode.DEFAULT_VOCABULARY).encode(texts)
    assert known.decode(ids[offsets[0] : offsets[1]].tolist()) == texts[0]
    assert known.decode(ids[offsets[1] : offsets[2]].tolist()) == texts[1]
    assert offsets[2] == offsets[3] == offsets[4]


def test_few_words_are_kept(monkeypatch, known):
    monkeypatch.setattr(encode, "KEPT_WORDS", 3)
    bpe = encode.ByteBpe(encode.DEFAULT_VOCABULARY)
    for text in ("one two three four five", "six one seven", "one"):
        ids, _ = bpe.encode([text])
        assert ids.tolist() == known.encode_ordinary(text)
    assert len(bpe.known) <= 3


def test_frame(spark, known):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
    rows = [(1, "Hello world", "x"), (2, None, None), (3, "", "x"), (None, "a", None), (1, "Hello world", "x")]
    out = encode.encode_documents(spark.createDataFrame(rows, schema)).collect()
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in out)
    assert got == sorted([(1, known.encode("Hello world"))] * 2 + [(2, []), (3, []), (0, known.encode("a"))])
    assert encode.encode_documents(spark.createDataFrame([], schema)).count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch, known):
    monkeypatch.setattr(encode.textcodes, "span_hashes", lambda values, starts, ends: (ends - starts).astype("uint64"))
    texts = ["one two six ten", "abc", "one"]
    ids, offsets = encode.ByteBpe(encode.DEFAULT_VOCABULARY).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [known.encode_ordinary(t) for t in texts]


def test_decoding_is_the_way_back(spark):
    rows = [(1, "naïve 日本語 😀\n"), (2, None), (3, ""), (4, "x" * 5000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in encode.decoded_documents(encode.encode_documents(frame)).collect()}
    assert got == {d: t or "" for d, t in rows}
