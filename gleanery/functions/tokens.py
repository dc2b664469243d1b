"""Token counts and offsets by encoding.

``portable_v1`` is a regular expression that gives the same tokens in Spark, in
Python and in other engines.  Other encodings are byte-level BPE vocabularies
named by the path of their rank file.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import lru_cache

import regex

PORTABLE = "portable_v1"
BLANK = r"[ \t\n\r\f\x0B]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"
#: A token with the white space after it; the first takes the white space before it too, so that tokens cover the text.
PIECE = rf"(?:\A{BLANK}+)?(?:{TOKEN}){BLANK}*"
_TOKEN = regex.compile(TOKEN)
# Fixed value: the word pattern of the public byte-level BPE vocabularies.
BPE_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_INSIDE = regex.compile(r"[\p{L}\p{N}_]{2}")


class Measured:
    """Token counts of spans of one text."""

    def __init__(self, tokens: "Tokens", text: str):
        self.tokens, self.text = tokens, text
        # of the portable encoding, tokens are found once and then counted by place
        self.starts = [m.start() for m in tokens.first_signs(text)] if tokens.encoding == PORTABLE else None

    def count(self, a: int, b: int) -> int:
        if self.starts is None:
            return self.tokens.count(self.text[a:b])
        if a >= b:
            return 0
        parted = a > 0 and _INSIDE.fullmatch(self.text, a - 1, a + 1) is not None  # the rest of a run is a token of its own
        return bisect_left(self.starts, b) - bisect_left(self.starts, a) + parted

    def windows(self, a: int, b: int, size: int, overlap: int) -> list[tuple[int, int]]:
        return self.tokens.windows(self.text[a:b], a, size, overlap)


class Tokens:
    """Counting and cutting by one encoding."""

    def __init__(self, encoding: str):
        self.encoding = encoding
        self._piece = regex.compile(PIECE) if encoding == PORTABLE else None
        self._bpe = None if self._piece else _bpe(encoding)

    def count(self, text: str) -> int:
        if not text:
            return 0
        return len(_TOKEN.findall(text)) if self._piece else len(self._bpe.encode_ordinary(text))

    @staticmethod
    def first_signs(text: str):
        return _TOKEN.finditer(text)

    def offsets(self, text: str) -> list[int]:
        """The first sign of each token, and the text's length."""
        if not text:
            return [0]
        if self._piece:
            return [m.start() for m in self._piece.finditer(text)] + [len(text)]
        raw, at, out = text.encode(), 0, []
        starts = {}
        for k, sign in enumerate(text):
            starts[at] = k
            at += len(sign.encode())
        place = 0
        for token in self._bpe.encode_ordinary(text):
            # a token that begins inside a sign belongs to the sign's place
            near = place
            while near not in starts:
                near -= 1
            out.append(starts[near])
            place += len(self._bpe.decode_single_token_bytes(token))
        assert place == len(raw)
        return [*out, len(text)]

    def windows(self, text: str, base: int, size: int, overlap: int) -> list[tuple[int, int]]:
        """Windows of `size` tokens that share `overlap` tokens with the one before, up to the one that reaches the end."""
        if size <= 0 or not 0 <= overlap < size:
            raise ValueError("need size > 0 and 0 <= overlap < size")
        at = self.offsets(text)
        n, out, begin = len(at) - 1, [], 0
        while begin < n:
            stop = min(begin + size, n)
            if at[stop] > at[begin]:
                out.append((base + at[begin], base + at[stop]))
            if stop == n:
                break
            begin += size - overlap
        return out


@lru_cache(maxsize=4)
def _bpe(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding(path, pat_str=BPE_WORDS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=8)
def tokens(encoding: str) -> Tokens:
    return Tokens(encoding)
