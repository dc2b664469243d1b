"""Token budgets per corpus, language and domain under a public tokenizer (problem 1).

For each language a regression predicts the number of tokens from counts of
bytes, words, digits, punctuation, blanks and scripts.  It is fitted on half of
a bounded sample of distinct texts of all lengths; the other half corrects its
bias and measures its errors.  The language of a text is told by a classifier of
pairs of signs, fitted on the documents whose meta names one.  Both are a few
numbers, are sent to all workers and run over every text in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import batches, encode, labels, textcodes

#: Distinct texts that are tokenized for fit and holdout together, as many of each power of two of the length as there are, taken by the hash of their text.
SAMPLE_ROWS = 6_000
#: Distinct labelled texts that the language classifier is fitted on, for each language.
LABELLED_ROWS = 400
#: Sampled texts of a language below which the model of all languages is used for it.
LEAST_ROWS = 60
#: Texts under so many tokens do not count in the measured error of single texts; none of their counts is cleared by an estimate.
SHORT = 30
#: Buckets that pairs of signs are hashed into.
PAIRS = 1 << 13
#: Ranges of code points counted as scripts.
SCRIPTS = {"cyrillic": (0x400, 0x52F), "kana": (0x3041, 0x30FF), "han": (0x4E00, 0x9FFF), "latin_marked": (0xC0, 0x24F), "other": (0x530, 0x303F)}
LANGUAGES = ("en", "de", "es", "fr", "ru", "ja")
WIDTH = 8 + len(SCRIPTS)


def features(texts: list) -> np.ndarray:
    """A row of counts for each text: bytes, words, numbers, other signs, blanks, capitals, words of digits, wide signs, and the scripts."""
    codes, offsets = textcodes.flat_codes([x or "" for x in texts])
    if not len(codes):
        return np.zeros((len(texts), WIDTH))
    kinds = encode.sign_classes()[codes]
    starts = encode.word_starts(codes, offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    wide = codes >= 0x80
    size = 1 + wide.astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    upper = (codes >= 65) & (codes <= 90)
    columns = [
        per_text(size), per_text(starts), per_text(kinds == 2), per_text(kinds == 3), per_text(kinds == 0), per_text(upper),
        per_text(starts & (kinds == 2)), per_text(wide),
    ]
    columns += [per_text((codes >= a) & (codes <= b)) for a, b in SCRIPTS.values()]
    return np.stack(columns, axis=1).astype(float)


def sign_pairs(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each pair of neighbouring signs of all texts, and the n + 1 offsets of the texts."""
    codes, offsets = textcodes.flat_codes([(x or "").lower() for x in texts])
    values = textcodes.code_values()[codes]
    inner = np.maximum(np.diff(offsets) - 1, 0)
    out = np.r_[0, np.cumsum(inner)]
    at = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], inner)
    return (textcodes.mix(values[at] * np.uint64(3) + values[at + 1]) % np.uint64(PAIRS)).astype(np.int64), out


@dataclass(frozen=True)
class LanguageModel:
    """log P(pair of signs) per language; the language under which a text is likeliest is its own."""

    logs: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "LanguageModel":
        """From how often each pair occurs in each language; every pair gets half an occurrence more."""
        weights = counts + 0.5
        return cls(np.log(weights / weights.sum(axis=1, keepdims=True)))

    def tell(self, texts: list) -> np.ndarray:
        """The number of each text's language; that of the first one for texts without a pair of signs."""
        pairs, offsets = sign_pairs(texts)
        scores = np.zeros((len(LANGUAGES), len(texts)))
        for k, log in enumerate(self.logs):
            total = np.r_[0.0, np.cumsum(log[pairs])]
            scores[k] = total[offsets[1:]] - total[offsets[:-1]]
        return np.argmax(np.round(scores, 6), axis=0)


def _portion(texts: DataFrame, rows: int, part: Column) -> DataFrame:
    """h, part, text: about `rows` distinct texts, as many of each part as it has or as its share allows, those with the lowest hashes.

    Hashes are put together before texts are, so that copies of a text count
    once; only the counts of the parts come to the driver.
    """
    named = texts.select("text", part.alias("part")).filter(F.col("part").isNotNull() & (F.col("text") != "")).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    sizes = {r["part"]: r["n"] for r in named.select("part", "h").distinct().groupBy("part").agg(F.count("*").alias("n")).collect()}
    left, shares = rows, {}
    for n, (name, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], str(x[0])))):
        shares[name] = min(size, left // (len(sizes) - n))
        left -= shares[name]
    if not shares:
        return named.filter(F.lit(False)).select("h", "part", "text")
    least = F.lit(0)
    for name, share in shares.items():
        least = F.when(F.col("part") == name, int(share / sizes[name] * (1 << 40))).otherwise(least)
    return named.filter(F.col("h") < least).groupBy("h", "part").agg(F.min("text").alias("text"))


def fit_languages(documents: DataFrame, rows: int = LABELLED_ROWS) -> LanguageModel:
    """Fit the classifier on documents (text, lang) whose lang names a known language, at most about `rows` of each."""
    chosen = _portion(documents, rows * len(LANGUAGES), F.when(labels.language(F.col("lang")).isin(*LANGUAGES), labels.language(F.col("lang"))))

    def run(stream):
        counts = np.zeros((len(LANGUAGES), PAIRS), np.int64)
        for batch, texts in batches.portions(stream):
            pairs, offsets = sign_pairs(texts)
            told = np.array([LANGUAGES.index(x) for x in batches.column(batch, "part").to_pylist()])
            keys = np.repeat(told, np.diff(offsets)) * PAIRS + pairs
            counts += np.bincount(keys, minlength=counts.size).reshape(counts.shape)
        some = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(counts[some]), pa.list_(pa.int64()))], names=["language", "counts"])

    parts = chosen.mapInArrow(run, "language int, counts array<long>").select("language", F.posexplode("counts").alias("pair", "n"))
    total = np.zeros((len(LANGUAGES), PAIRS))
    for row in parts.groupBy("language", "pair").agg(F.sum("n").alias("n")).filter("n > 0").collect():  # at most a number for each language and bucket
        total[row["language"], row["pair"]] = row["n"]
    return LanguageModel.of(total)


@dataclass(frozen=True)
class TokenModel:
    """Coefficients and bias per language, and what the holdout shows of their errors.

    `slack` is the error of single texts as a factor above 1, `noise` the
    deviation of a text of one token (it grows with the root of the size),
    `drift` the error of the bias itself, as a share.  `low` and `high` bound the
    counts for each byte that sampled texts of the language have.
    """

    languages: LanguageModel
    weights: np.ndarray
    bias: np.ndarray
    slack: np.ndarray
    noise: np.ndarray
    drift: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def predict(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimated tokens of each text (0 for null and empty ones), the number of its language, and whether it is like the sampled texts."""
        rows, language = features(texts), self.languages.tell(texts)
        raw = np.einsum("ij,ij->i", rows, self.weights[language]) * self.bias[language]
        shape = rows[:, 1:] / np.maximum(rows[:, :1], 1)
        known = ((shape >= self.low[language]) & (shape <= self.high[language])).all(axis=1)
        return np.clip(raw, np.where(rows[:, 0] > 0, 1, 0), rows[:, 0]), language, known


def fit(texts: DataFrame, languages: LanguageModel, vocabulary: str = encode.DEFAULT_VOCABULARY, sample_rows: int = SAMPLE_ROWS) -> TokenModel:
    """Fit on half of a sample of about `sample_rows` distinct texts, correct and measure on the other half.

    The sample has as many texts of each power of two of the length as there
    are or as fit in, whole ones.  Only their counts come to the driver.
    Without any text the model predicts a token for four bytes and clears
    nothing.
    """
    chosen = _portion(texts, sample_rows, F.floor(F.log2(F.octet_length("text") + 1)))

    def work(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        counts = encode.ByteBpe.load(vocabulary).count(rows)
        return pa.RecordBatch.from_arrays(
            [batches.column(batch, "h"), pa.array(languages.tell(rows)), pa.array(counts.astype(np.int64)), pa.array(list(features(rows)), pa.list_(pa.float64()))],
            names=["h", "language", "tokens", "row"],
        )

    sample = batches.map_portions(chosen.select("h", "text"), "h long, language long, tokens long, row array<double>", work).toPandas()
    return _fit_sample(sample.sort_values("h"), languages)


def _fit_sample(sample: pd.DataFrame, languages: LanguageModel) -> TokenModel:
    kinds = len(LANGUAGES)
    plain = np.zeros(WIDTH)
    plain[0] = 0.25
    if sample.empty:
        none = np.zeros((kinds, WIDTH - 1))
        return TokenModel(languages, np.tile(plain, (kinds, 1)), np.ones(kinds), np.full(kinds, np.inf), np.ones(kinds), np.ones(kinds), none + 1, none)
    rows = np.stack(sample["row"].to_numpy())
    tokens, language = sample["tokens"].to_numpy(float), sample["language"].to_numpy()
    fitted = np.arange(len(sample)) % 2 == 0
    shape = rows[:, 1:] / np.maximum(rows[:, :1], 1)
    weights, bias, slack, noise, drift = np.zeros((kinds, WIDTH)), np.ones(kinds), np.ones(kinds), np.ones(kinds), np.ones(kinds)
    low, high = np.zeros((kinds, WIDTH - 1)), np.zeros((kinds, WIDTH - 1))
    for k in range(kinds):
        own = language == k
        if (own & fitted).sum() < LEAST_ROWS:
            own = np.ones(len(sample), bool)
        x, y = rows[own & fitted], tokens[own & fitted]
        scale = 1 / np.sqrt(np.maximum(y, 1))  # errors grow with the square root of the size
        lhs = x * scale[:, None]
        ridge = 1e-3 * np.trace(lhs.T @ lhs) / WIDTH / len(x) + 1e-9
        weights[k] = np.linalg.solve(lhs.T @ lhs + ridge * np.eye(WIDTH), lhs.T @ (y * scale))
        held = own & ~fitted if (own & ~fitted).any() else own
        guess = np.maximum(rows[held] @ weights[k], 1e-9)
        bias[k] = tokens[held].sum() / guess.sum()
        left = tokens[held] - guess * bias[k]
        noise[k] = np.sqrt(np.mean(left**2 / np.maximum(tokens[held], 1)))
        drift[k] = np.sqrt((left**2).sum()) / max(tokens[held].sum(), 1)
        long = tokens[held] >= SHORT
        ratio = np.abs(np.log(np.maximum(guess[long] * bias[k], 1) / np.maximum(tokens[held][long], 1)))
        slack[k] = max(1.3, float(np.exp(2 * ratio.max()))) if len(ratio) else np.inf
        like = shape[own & (tokens >= SHORT)]
        if len(like):
            low[k], high[k] = like.min(axis=0), like.max(axis=0)
    return TokenModel(languages, weights, bias, slack, noise, drift, low, high)


def _model(documents: DataFrame, texts: DataFrame, vocabulary: str, sample_rows: int):
    """The fitted model, sent to all workers: a few numbers for each language and pair of signs."""
    return texts.sparkSession.sparkContext.broadcast(fit(texts, fit_languages(documents), vocabulary, sample_rows))


def unusable_counts(chunks: DataFrame, vocabulary: str = encode.DEFAULT_VOCABULARY, documents: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """chunk_id of chunks whose token_count is null, not positive, or off by more than a factor of two.

    The model estimates every text.  A count that is as the estimate says, well
    within twice the largest error (as a logarithm) that the holdout shows, of a
    text that is like the sampled ones, is cleared; every other text is
    tokenized, and its exact count decides.  A null or empty text has 0 tokens,
    so that any positive count is too large.  `documents` (text, lang) teach the
    language classifier; without them all texts are of one language to it.
    """
    rows = chunks.select("chunk_id", "text", F.col("token_count").cast("double").alias("told")).filter("chunk_id is not null")
    unusable = rows.filter("told is null or told <= 0").select("chunk_id")
    labelled = documents if documents is not None else chunks.select(F.lit("").alias("text"), F.lit(None).cast("string").alias("lang")).limit(0)
    model = _model(labelled, rows, vocabulary, sample_rows)

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        told = batches.column(batch, "told").to_numpy(zero_copy_only=False)
        guess, language, known = model.value.predict(texts)
        slack = model.value.slack[language]
        cleared = known & (guess >= SHORT * slack) & (told * slack <= 2 * guess) & (2 * told >= guess * slack)
        open_ = np.flatnonzero(~cleared)
        true = encode.ByteBpe.load(vocabulary).count([texts[i] for i in open_.tolist()])
        bad = open_[(told[open_] > 2 * true) | (2 * told[open_] < true)]
        return pa.RecordBatch.from_arrays([batches.column(batch, "chunk_id").take(pa.array(bad))], names=["chunk_id"])

    wrong = batches.map_portions(rows.filter("told > 0"), "chunk_id string", work)
    return unusable.unionByName(wrong).distinct()


def _estimates(rows: DataFrame, model) -> DataFrame:
    """The columns of `rows` other than text, and told: the estimate, the variance of its noise, and its drift."""
    kept = [c for c in rows.columns if c != "text"]

    def work(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        tokens, language, _ = model.value.predict(texts)
        noise, drift = model.value.noise[language] ** 2 * tokens, model.value.drift[language] * tokens
        return pa.RecordBatch.from_arrays(
            [*(batches.column(batch, c) for c in kept), *map(pa.array, (tokens, noise, drift))], names=[*kept, "tokens", "noise", "drift"],
        )

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return batches.map_portions(rows, f"{kinds}, tokens double, noise double, drift double", work)


def token_budget(docs: DataFrame, chunks: DataFrame, vocabulary: str = encode.DEFAULT_VOCABULARY, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """record_kind, corpus, language, domain, n_records, tokens, error: estimated totals, each record counted once.

    Language and domain come from the document's meta in one spelling ('und'
    and 'unknown' where missing); a chunk has those of its document.  Records
    with a null id are left out; null and empty texts count 0 tokens.  error is
    the standard error of the total as a share of it, from the holdout: what
    single texts add at random, and what the bias of a language adds to all.
    """
    document = docs.filter("doc_id is not null").select("doc_id", "corpus", "text", F.col("meta")["lang"].alias("lang"), F.col("meta")["domain"].alias("domain"))
    chunk = chunks.filter("chunk_id is not null").select("chunk_id", "doc_id", "corpus", "text")
    model = _model(document, document.select("text").unionByName(chunk.select("text")), vocabulary, sample_rows)
    best = F.max(F.struct("tokens", "noise", "drift")).alias("e")
    own = _estimates(document, model).groupBy("doc_id").agg(
        F.first("corpus").alias("corpus"), F.max(labels.language(F.col("lang"))).alias("language"),
        F.max(labels.domain(F.col("domain"))).alias("domain"), best,
    )
    parts = _estimates(chunk, model).groupBy("chunk_id").agg(F.first("doc_id").alias("doc_id"), F.first("corpus").alias("corpus"), best)
    placed = parts.join(own.select("doc_id", "language", "domain"), "doc_id", "left").select(
        F.lit("child").alias("record_kind"), "corpus", F.coalesce("language", F.lit("und")).alias("language"),
        F.coalesce("domain", F.lit("unknown")).alias("domain"), "e",
    )
    every = placed.unionByName(own.select(F.lit("doc").alias("record_kind"), "corpus", "language", "domain", "e"))
    deviation = F.sqrt(F.sum("e.noise") + F.sum("e.drift") * F.sum("e.drift"))
    error = F.when(F.sum("e.tokens") > 0, F.round(deviation / F.sum("e.tokens"), 6)).otherwise(F.lit(0.0))
    return every.groupBy("record_kind", "corpus", "language", "domain").agg(
        F.count("*").alias("n_records"), F.round(F.sum("e.tokens")).cast("long").alias("tokens"), error.alias("error"),
    )
