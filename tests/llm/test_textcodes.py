import re
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import textcodes

ALPHABET = st.text(alphabet=st.sampled_from(list("aB9_ -'.\n\téİΣςßﬁ²½ "
    "がカｶー日本ひ́̈한국😀Ж\x00\x1c�")), max_size=40)


def plain_words(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text or "") if unicodedata.category(c) != "Mn").lower()
    out, run = [], ""
    for c in text:
        single = any(a <= ord(c) <= b for a, b in textcodes.SINGLE_RANGES)
        if c.isalnum() and not single:
            run += c
            continue
        if run:
            out.append(run)
            run = ""
        if single:
            out.append(c)
    return out + [run] if run else out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=6))
def test_words_equal_the_plain_definition(texts):
    hashes, offsets = textcodes.words(texts)
    names = {}
    for i, text in enumerate(texts):
        want = plain_words(text)
        got = hashes[offsets[i] : offsets[i + 1]].tolist()
        assert len(want) == len(got)
        for w, h in zip(want, got):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_no_texts_and_empty_texts():
    for texts in ([], [None], ["", None, "  "], ["́"]):
        hashes, offsets = textcodes.words(texts)
        assert len(hashes) == 0 and offsets.tolist() == [0] * (len(texts) + 1)


def test_run_hashes_stay_inside_texts():
    hashes, offsets = textcodes.words(["a b c", "b c d e", "x"])
    runs, at = textcodes.run_hashes(hashes, offsets, 2)
    assert np.diff(at).tolist() == [2, 3, 0]
    assert runs[1] == runs[2]  # "b c" in both


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(1, 12))
def test_sliding_minimum(values, width):
    array = np.array(values, np.uint64)
    want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert textcodes.sliding_minimum(array, width).tolist() == want


def test_very_long_word_and_text():
    hashes, offsets = textcodes.words(["x" * 300_000, ("w " * 100_000)])
    assert np.diff(offsets).tolist() == [1, 100_000]
    assert len(re.findall("w", "w " * 100_000)) == 100_000
