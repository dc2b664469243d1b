"""Encoding a whole corpus with a public byte-level BPE vocabulary (problem 6).

Texts are cut into words by array operations on code-point classes, each
distinct word of a portion is merged once, and the ids are put together by
gathers.  Merging works on many words at a time: the symbols of all words lie in
one flat array, and each round finds the rank of every neighbouring pair by
binary search over the sorted pair keys and merges each word's lowest pair.

Defined results: a null or an empty text has no ids; strings that look like
special tokens are ordinary text; repeated rows are encoded like any other.
"""

from __future__ import annotations

import base64
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleanery.llm import batches, textcodes

#: Where the vocabulary files lie; every function takes another path as a parameter.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose ids a worker keeps, so that memory stays bounded; beyond it the memory is emptied.
KEPT_WORDS = 250_000

# The word endings that the vocabulary's word pattern splits off after an apostrophe.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_vocabularies: dict[str, "ByteBpe"] = {}
_classes: list[np.ndarray] = []


def sign_classes() -> np.ndarray:
    """For each code point: white space, letter (L*), number (N*) or other."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for code in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(code))[0]
            if kind == "L":
                table[code] = _LETTER
            elif kind == "N":
                table[code] = _NUMBER
        table[list(textcodes.WHITE_SPACE)] = _SPACE
        _classes.append(table)
    return _classes[0]


def word_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A mark at the first code point of each word of the vocabulary's pattern.

    Words are runs of one class.  A blank directly before a run belongs to it,
    the white space before that blank is a word of its own, and the endings
    after a lone apostrophe are split from the letters that follow.
    """
    n = len(codes)
    kinds = sign_classes()[codes]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # position n closes the last text
    start = begins[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # the last white space before something else, within one text
    before = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE) & ~begins[1:n])
    start[before] = True
    start[before[codes[before] == 0x20] + 1] = False
    # an apostrophe that begins a word and is followed by letters of the same text
    quote = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kinds[1:] == _LETTER) & ~begins[1:n])
    if len(quote):
        one = np.isin(codes[quote + 1], [ord(x) for x in SHORT_ENDINGS])
        room = np.minimum(quote + 2, n - 1)
        inside = (quote + 2 < n) & ~begins[room]
        two = np.zeros(len(quote), bool)
        for ending in LONG_ENDINGS:
            two |= inside & (codes[quote + 1] == ord(ending[0])) & (codes[room] == ord(ending[1]))
        start[quote[one | two] + 1] = False
        for cut in (quote[one] + 2, quote[two] + 3):
            start[cut[cut < n]] = True
    return start


def _all_equal(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word (starts, ends) has the same signs as the word whose number `like` gives."""
    sizes = ends - starts
    if (sizes != sizes[like]).any():
        return False
    shift = np.repeat(starts[like] - starts, sizes)
    at = np.arange(starts[0], ends[-1]) if len(starts) else starts  # words lie one after another
    return bool((codes[at] == codes[at + shift]).all())


class ByteBpe:
    """A byte-level BPE vocabulary: ranks of byte strings, merged in batches of words."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if parts := line.split():
                    ranks[base64.b64decode(parts[0])] = int(parts[1])
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ids = np.array(merged, np.int64)[order]
        self.whole = ranks
        self.known: dict[str, tuple[int, ...]] = {}
        self.bytes_of: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        """The vocabulary of a file, read once in each worker."""
        if path not in _vocabularies:
            _vocabularies[path] = cls(path)
        return _vocabularies[path]

    def _pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, which is also its rank; `size` where it merges into none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], self.size)

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of non-empty words, by rounds over all of them at once.

        In each round every word merges all places of its lowest pair, from the
        left and without overlap; words that have no pair left are put aside.
        """
        done: list[tuple[int, ...]] = [()] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            joined = np.full(len(symbols), self.size, np.int64)
            inner = owner[:-1] == owner[1:]
            joined[:-1][inner] = self._pair_ids(symbols[:-1][inner], symbols[1:][inner])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(joined, first)
            spans = np.diff(np.r_[first, len(symbols)])
            ended = best == self.size
            if ended.any():
                for k in np.flatnonzero(ended).tolist():
                    done[owner[first[k]]] = tuple(symbols[first[k] : first[k] + spans[k]].tolist())
                stay = np.repeat(~ended, spans)
                symbols, owner, joined = symbols[stay], owner[stay], joined[stay]
                best, spans = best[~ended], spans[~ended]
                if not len(symbols):
                    break
            hit = joined == np.repeat(best, spans)
            # of neighbouring hits (a run of one repeated symbol) every second one counts, from the left
            index = np.arange(len(hit))
            opens = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(opens, index, 0))
            hit &= (index - run) % 2 == 0
            symbols = np.where(hit, joined, symbols)
            keep = ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        return done

    def _learn(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words not met before; they are kept for later portions."""
        learnt: dict[str, tuple[int, ...]] = {}
        rest: list[tuple[str, bytes]] = []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            rank = self.whole.get(data)
            if rank is None:
                rest.append((word, data))
            else:
                learnt[word] = (rank,)
        if rest:
            learnt.update(zip([w for w, _ in rest], self.merge_words([d for _, d in rest])))
        if len(self.known) + len(learnt) > KEPT_WORDS:
            self.known.clear()
        if len(learnt) <= KEPT_WORDS:
            self.known.update(learnt)
        return learnt

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one flat array, and the n + 1 offsets of the texts."""
        plain = [x or "" for x in texts]
        codes, offsets = textcodes.flat_codes(plain)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts = np.flatnonzero(word_starts(codes, offsets))
        ends = np.r_[starts[1:], len(codes)]
        hashes = textcodes.span_hashes(textcodes.code_values()[codes], starts, ends)
        _, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        joined = "".join(plain)
        if _all_equal(codes, starts, ends, where[which]):
            distinct = [joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        else:  # two words with one hash: the words themselves tell them apart
            number: dict[str, int] = {}
            which = np.array([number.setdefault(joined[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist())])
            distinct = list(number)
        pieces = [self.known.get(w) for w in distinct]
        unknown = [w for w, ids in zip(distinct, pieces) if ids is None]
        if unknown:
            learnt = self._learn(unknown)
            pieces = [learnt[w] if ids is None else ids for w, ids in zip(distinct, pieces)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        table = np.fromiter((i for ids in pieces for i in ids), np.int32, int(sizes.sum()))
        at = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        counts = sizes[which]
        ahead = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ahead[1:])
        ids = table[np.arange(ahead[-1]) + np.repeat(at[:-1][which] - ahead[:-1], counts)]
        return ids, ahead[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of flat ids with the n + 1 offsets of the texts."""
        if self.bytes_of is None:
            tokens = [b""] * self.size
            for token, rank in self.whole.items():
                tokens[rank] = token
            lengths = np.fromiter(map(len, tokens), np.int64, self.size)
            self.bytes_of = np.frombuffer(b"".join(tokens), np.uint8), np.r_[0, np.cumsum(lengths)]
        data, at = self.bytes_of
        sizes = at[ids + 1] - at[ids]
        ahead = np.r_[0, np.cumsum(sizes)]
        raw = data[np.arange(ahead[-1]) + np.repeat(at[ids] - ahead[:-1], sizes)].tobytes()
        cuts = ahead[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        return np.diff(self.encode(texts)[1])


def encode_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key and ``ids``, the text's list of token ids.

    A null or empty text gives an empty list; a null key stays null; columns
    other than the two named are not read.  One pass, no shuffle.
    """
    source = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    kind = source.schema["key"].dataType

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        ids, offsets = ByteBpe.load(vocabulary).encode(texts)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([batches.column(batch, "key"), lists], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return batches.map_portions(source, schema, work)



def decoded_documents(encoded: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id") -> DataFrame:
    """The key and text of each row of ids; the way back of `encode_documents`. A null or empty list gives an empty text."""
    kind = encoded.schema[key].dataType

    def run(stream):
        for batch in stream:
            lists = batches.column(batch, "ids")
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = ByteBpe.load(vocabulary).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batches.column(batch, key), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType())]))
