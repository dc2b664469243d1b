import numpy as np
import pytest
from hypothesis import given, settings as hypo
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery import ids, settings
from gleanery.functions import labels, markdown, sentences, text as textual, vectors
from gleanery.functions.tokens import PORTABLE, Tokens, tokens


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [
    ("", "\n"), ("x", "x\n"), ("\n\n", "\n"), ("  \tx  ", "x\n"), ("a \r\n b\t\r\r\n\n\n\nc", "a\n b\n\nc\n"), ("one\n\n\n\ntwo\n", "one\n\ntwo\n"),
    ("cafe\u0301\u3000", "caf\u00e9\n"), ("\u3000a\u00a0\n\u2003\nb", "a\n\nb\n"), ("e\u0301 end", "\u00e9 end\n"), ("a\rb", "a\nb\n"),
])
def test_normalize(spark, text, want):
    assert one(spark, text, textual.normalize) == want and one(spark, want, textual.normalize) == want


FENCED = "# A\n\n```py\n# no heading\n| a | b |\n| --- | --- |\n```\n## B ##\ntext\n| x | y |\n|:---|---:|\n| 1 | 2 |\n\n```open\n# C\n"


def test_markup(spark):
    assert one(spark, FENCED, textual.count_fences) == 1
    assert one(spark, FENCED, textual.mask_fences) == FENCED.replace("```py\n# no heading\n| a | b |\n| --- | --- |\n```", "\n\n\n\n")
    assert [tuple(h) for h in one(spark, FENCED, textual.headings)] == [(1, "A"), (2, "B ##"), (1, "C")]
    assert one(spark, FENCED, textual.count_tables) == 1
    (span,) = markdown.tables(FENCED)
    assert FENCED[slice(*span)] == "| x | y |\n|:---|---:|\n| 1 | 2 |"
    assert markdown.tables("---\n") == [] and one(spark, "---", textual.count_tables) == 0
    found, fences = markdown.structure("Title\n=====\n\n~~~\n# x\n~~~\n> ## Quoted\n- # item\n\n    # code\n\nText\n---\n```\nopen")
    assert [(h.level, h.title) for h in found] == [(1, "Title"), (2, "Quoted"), (1, "item"), (2, "Text")]
    assert len(fences) == 2


@pytest.mark.parametrize(("text", "label"), [("plain English", "en"), ("これは日本語", "ja"), ("中文", "zh"), ("Привет", "ru"), ("für", "de"), ("¿qué niño?", "es"), ("cœur déjà", "fr"), ("한국", "ko"), (None, None)])
def test_script_label(spark, text, label):
    assert one(spark, text, textual.script_label) == label


@pytest.mark.parametrize(("text", "want"), [
    ("Mrs. Lowe paid at noon. He went home.", [0, 24, 37]), ("Blue Harbor, Ltd. Annual figures are below.", [0, 43]), ("K. Ito. No!", [0, 8, 11]), ("1.5 miles. 7 left", [0, 11, 17]), ("b. C", [0, 4]), ("", [0]),
    ("Why!?) \"So\"", [0, 7, 11]), ("end. \u00e9clair", [0, 11]), ("x\u0001yy. Then", [0, 6, 10]), ("NO. Then", [0, 8]), ("A_b. Next", [0, 5, 9]), ("...Go. ", [0, 7]), ("Ends here. ", [0, 11]), ("\u00c4. B. C", [0, 7]), ("Stop.  \n# Title", [0, 8, 15]),
])
def test_sentences(spark, text, want):
    assert sentences.sentence_edges(text).tolist() == want
    assert [(s["start"], s["end"]) for s in one(spark, text, textual.sentence_spans)] == list(zip(want, want[1:]))


def slow_edges(text):
    """By single characters: an end of a sentence at each place where the rule holds."""
    out = [0]
    for p in range(1, len(text)):
        if not (text[p - 1].isspace() and text[p] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\"'\u2018\u201c(#`-*>|"):
            continue
        head = text[:p].rstrip()
        head = head.rstrip("\"'\u2019\u201d)")
        body = head.rstrip(".!?")
        word = ""
        while len(word) < len(body) and (body[-1 - len(word)].isalnum() or body[-1 - len(word)] == "_"):
            word += body[-1 - len(word)]
        if body != head and len(word) != 1 and word[::-1].lower() not in sentences.ABBREVIATIONS:
            out.append(p)
    return [*out, len(text)] if text else [0]


@hypo(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"aAé. !?\n\"')-1日_", "Dr", "Inc", ". B"]), max_size=40).map("".join))
def test_sentences_agree_with_single_steps(text):
    assert sentences.sentence_edges(text).tolist() == slow_edges(text)


def test_sentences_of_a_long_text_take_no_longer_than_its_length():
    import time

    text = "Some words make a sentence. " * 400_000  # 11 million signs
    began = time.perf_counter()
    assert len(sentences.sentence_edges(text)) == 400_001 and time.perf_counter() - began < 20


def test_small_functions(spark):
    assert one(spark, "auth-token_lifecycle", textual.humanized) == "Auth Token Lifecycle" and one(spark, "--", textual.humanized) == "--"
    assert one(spark, "  a \n b ", textual.preview) == "a b" and len(one(spark, "x" * 99, textual.preview)) == 60
    long = "x" * 12_000
    assert one(spark, f"{long}-y", textual.humanized) == f"X{long[1:]} Y"
    assert [one(spark, x, labels.split_name) for x in (" Tst\u00a0", "VALID", "odd", None)] == ["test", "dev", None, None]
    assert one(spark, "The MAX_RETRY_2 value", textual.has_identifier) and not one(spark, "The MAX value", textual.has_identifier)
    assert one(spark, "Über_1 x-Y", textual.lexical_terms) == ["ber_1", "x", "y"]


def test_portable_tokens(spark):
    text = "  Two_words, and 日本 é!\n"
    t = tokens(PORTABLE)
    assert t.count(text) == one(spark, text, textual.portable_token_count) == 7 and t.count("") == 0 and t.offsets("") == [0]
    offsets = t.offsets(text)
    assert offsets[0] == 0 and offsets[-1] == len(text) and len(offsets) == 8
    assert t.windows(text, 10, 4, 1)[0][0] == 10 and t.windows(text, 0, 4, 1)[-1][1] == len(text)
    with pytest.raises(ValueError):
        t.windows(text, 0, 4, 4)


def test_bpe_tokens_cover_the_text():
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    t = Tokens(path)
    text = "naïve 日本語 😀 text"
    offsets = t.offsets(text)
    assert t.count(text) == len(offsets) - 1 and offsets[0] == 0 and offsets[-1] == len(text) and offsets == sorted(offsets)


def test_vectors(spark):
    assert np.allclose(one(spark, [3.0, 4.0], vectors.l2_normalized, "array<double>"), [0.6, 0.8])
    assert one(spark, [0.0, 0.0], vectors.l2_normalized, "array<double>") == [0.0, 0.0]
    assert np.allclose(one(spark, [3.0, 4.0, 9.0], lambda c: vectors.truncated(c, 2), "array<double>"), [0.6, 0.8])
    with pytest.raises(ValueError):
        vectors.truncated(F.col("x"), 0)
    a, b, c = vectors.hash_vectors(["Some words some", "some  WORDS some", ""])
    assert abs(float(np.linalg.norm(a)) - 1) < 1e-6 and np.array_equal(a, b) and np.linalg.norm(c) > 0.99
    out = spark.createDataFrame([("a b",), (None,)], "x string").select(vectors.embedding(F.col("x"), "hash").alias("v")).collect()
    assert out[1]["v"] is None and np.allclose(out[0]["v"], vectors.hash_vectors(["passage: a b"])[0])
    with pytest.raises(ValueError):
        vectors.embedding(F.col("x"), "bge-small", {"query_prefix": "", "doc_prefix": ""})
    with pytest.raises(ValueError):
        vectors.embedding(F.col("x"), "minilm", {"truncate_dim": 999})


def test_word_sums_are_the_same_in_any_portion(monkeypatch):
    texts = ["a b c", "", "b b", "  ", "d", "a " * 50]
    whole = vectors.word_sums(texts)
    monkeypatch.setattr(vectors, "_WORDS_AT_ONCE", 2)
    assert np.allclose(vectors.word_sums(texts), whole) and not whole[1].any() and np.allclose(whole[2], 2 * vectors.word_sums(["b"])[0])
    small = vectors._WordTable(4, room=3)
    first = small.matrix[small.rows(["x", "y"])].copy()
    small.rows(["p", "q"])
    assert len(small.row) <= 3 and np.array_equal(small.matrix[small.rows(["x", "y"])], first)


def test_long_vectors_are_normalized_in_linear_steps(spark):
    v = [float(i) for i in range(20_000)]
    assert np.allclose(one(spark, v, vectors.l2_normalized, "array<double>"), np.array(v) / np.linalg.norm(v))


def test_hashes_and_ids(spark):
    assert settings.params_hash({"min_chars": 40}) == settings.params_hash({"min_chars": 40, "note": "x", "name": "y", "b": 1, "_nohash": ["b"]}) == "12408410"
    assert settings.params_hash({"doc_prefix": "passage: ", "query_prefix": "query: "}) == "d84904a3"
    made = spark.range(1).select(ids.doc_id(F.lit("api_docs"), F.lit("fixtures\\raw/api_docs/authentication.md")).alias("d"), ids.chunk_id(F.lit("409159541a40"), F.lit(0), F.lit(16), F.lit("paragraph_fixture:12408410")).alias("c")).first()
    assert tuple(made) == ("409159541a40", "548f42a0cbb1dbf7")
    shares = {r["s"]: r["count"] for r in spark.range(2000).select(ids.split_of(F.format_string("q%04d", "id")).alias("s")).groupBy("s").count().collect()}
    assert 0.55 < shares["train"] / 2000 < 0.65 and set(shares) == {"train", "dev", "test"}
    assert ids.cell_id("c", "s", "i", "dense", {}, 10) != ids.cell_id("c", "s", "i", "dense", {}, 10, "dev")


def test_settings(tmp_path):
    assert settings.overrides(["a.b=1", "a.c=true", "d=x=y", "e=none", "f=1.5"]) == {"a": {"b": 1, "c": True}, "d": "x=y", "e": None, "f": 1.5}
    with pytest.raises(ValueError):
        settings.overrides(["a"])
    path = tmp_path / "c.json"
    path.write_text('{"seed": 7, "defaults": {"k": 3}, "other": {"x": 1}}')
    got = settings.load_settings(path, {"defaults": {"chunker": "fixed"}, "seed": 8})
    assert (got.seed, got.defaults.k, got.defaults.chunker, got.extra) == (8, 3, "fixed", {"other": {"x": 1}})
    with pytest.raises(FileNotFoundError):
        settings.load_settings(tmp_path / "none.json")
