"""Vectorised text kernels: many texts as one flat numpy array of code points.

Every kernel works on a whole Arrow batch at once.  Nothing here loops over
characters or words in Python, and no text is cut short.  Texts of a batch are
separated by positions, never by a sentinel character, so any code point may
occur in them.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

#: Values that a run of kana or kanji is cut at: each such sign is a word of its own (TESTDATA.md).
SINGLE_RANGES = ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x30FC, 0x30FC), (0x4E00, 0x9FFF))
#: The Unicode property White_Space.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

SEPARATOR, LETTER, SINGLE, MARK = 0, 1, 2, 3
_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
_powers: dict[int, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words with good avalanche."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def word_classes() -> np.ndarray:
    """For each code point SEPARATOR, LETTER (letters and digits), SINGLE or MARK (category Mn)."""
    if "classes" not in _tables:
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for code in range(sys.maxunicode + 1):
            sign = chr(code)
            if sign.isalnum():
                table[code] = LETTER
            elif unicodedata.category(sign) == "Mn":
                table[code] = MARK
        for low, high in SINGLE_RANGES:
            table[low : high + 1] = SINGLE
        _tables["classes"] = table
    return _tables["classes"]


def code_values() -> np.ndarray:
    if "values" not in _tables:
        _tables["values"] = mix(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * _BASE)
    return _tables["values"]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64 (or of its inverse)."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16) * 5 // 4, _BASE_INVERSE if inverse else _BASE, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[inverse] = have
    return have[:n]


def flat_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array and the n + 1 offsets of the texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, offsets


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each span, by prefix sums."""
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(len(values) + 1, inverse=True)[starts])


def fold(text: str | None) -> str:
    """NFKD and lower case; category Mn is dropped later, on code points.

    Lowering before the marks go gives the same letters: the only rule that
    looks at neighbours (final sigma) skips marks.
    """
    if not text:
        return ""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).lower()


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the n + 1 offsets of the texts among them.

    A null or wordless text has no words.
    """
    codes, offsets = flat_codes([fold(x) for x in texts])
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    classes = word_classes()[codes]
    marks = classes == MARK
    if marks.any():
        keep = ~marks
        kept = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=kept[1:])
        codes, classes, offsets = codes[keep], classes[keep], kept[offsets]
        if not len(codes):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = classes != SEPARATOR
    first = word.copy()
    # a word goes on where both neighbours are letters and no text begins between them
    first[1:] &= ~((classes[1:] == LETTER) & (classes[:-1] == LETTER))
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    last = np.zeros(len(codes), bool)
    last[:-1] = word[:-1] & (first[1:] | ~word[1:])
    last[-1] = word[-1]
    closing = begins[1:] - 1
    last[closing] = word[closing]
    ends = np.flatnonzero(last) + 1
    return span_hashes(code_values()[codes], starts, ends), np.searchsorted(starts, offsets)


def run_hashes(values: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `length` consecutive values inside one text, and their n + 1 offsets."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    starts = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], counts)
    return span_hashes(values, starts, starts + length), out


def distinct_sorted(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted upwards without repetition, and their offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=len(offsets) - 1), out=out[1:])
    return hashes[keep], out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i : i + width]) for each i that has a full window, in linear time.

    Prefix minima of blocks of `width` and suffix minima of the same blocks
    meet in one element-wise minimum.
    """
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])
