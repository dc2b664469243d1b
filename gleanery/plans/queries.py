"""Named queries over the tables of a folder, with equivalent SQL for those that SQL can express.

"Sent again" rows are one record: every query first takes the distinct values
of the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import ids, scratch
from gleanery.functions import labels, sentences, text as textual, vectors
from gleanery.functions.tokens import PIECE, TOKEN
from gleanery.operators import ann, chunkers, metrics, relations, retrieval, stats
from gleanery.plans import matrix

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[query.__name__] = query
        if sql:
            _SQL[query.__name__] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- tables ---


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, those sent again twice; queries take distinct results, which are narrower than texts."""
    return _t(spark, folder, "corpus_docs").select("doc_id", "corpus", "source_path", "title", "text")


def _chunks(spark: SparkSession, folder: str, *columns: str, table: str = "chunks_child") -> DataFrame:
    """Distinct values of the named columns only, so that texts are read and shuffled where they are needed and nowhere else."""
    return _t(spark, folder, table).select(*columns).distinct()


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Eval pairs that have a query, of every split."""
    rows = _t(spark, folder, "evalset").filter("query is not null and query_id is not null")
    return rows.select("query_id", "corpus", "query", "gold_doc_id", "gold_char_spans").distinct()


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table as documents of one corpus."""
    return _t(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("documents").alias("corpus"), "text")


_DOCS_SQL = "docs AS (SELECT DISTINCT doc_id, corpus, source_path, title, text FROM corpus_docs)"
_CHUNKS_SQL = "chunks AS (SELECT DISTINCT chunk_id, doc_id, corpus, chunk_set_id, text, char_start, char_end, token_count, ordinal, parent_id FROM chunks_child)"
_PAIRS_SQL = "pairs AS (SELECT DISTINCT query_id, corpus, query, gold_doc_id, gold_char_spans FROM evalset WHERE query IS NOT NULL AND query_id IS NOT NULL)"
_SPACES = "\\t-\\r\\x1c-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_SPLIT_SQL = f"CASE lower(regexp_replace(split, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.SPLITS.items()) + " END"
_MASKED_SQL = r"""(SELECT array_to_string(list_transform(list_zip(string_split_regex(text, '(?s)```.*?```'), list_transform(regexp_extract_all(text, '(?s)```.*?```'), lambda b: regexp_replace(b, '[^\n]', '', 'g'))), lambda z: z[1] || coalesce(z[2], '')), ''))"""


def _fixed(text: str) -> str:
    """A regular expression as an SQL string."""
    return "'" + text.replace("'", "''") + "'"


# --- text functions ---


@_register(f"SELECT DISTINCT doc_id, len(regexp_extract_all(coalesce(text, ''), {_fixed(TOKEN)}))::BIGINT AS tokens FROM documents")
def token_counts(spark, folder):
    return _t(spark, folder, "documents").select("doc_id", "text").select("doc_id", textual.portable_token_count(F.col("text")).cast("long").alias("tokens"))


_WS = "\\t-\\r\\x1c-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}".replace("\\x1c-\\x20", "\\x20")


@_register(rf"""WITH a AS (SELECT DISTINCT doc_id, regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[{_WS}]*\n', chr(10), 'g'), '[{_WS}]*$', '') AS t, t AS raw FROM a),
c AS (SELECT doc_id, array_to_string(list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(x, '[{_WS}]+$', '')), chr(10)) AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM c)
SELECT doc_id, sha1(regexp_replace(regexp_replace(t, '^[{_WS}]+', ''), '[{_WS}]+$', '') || chr(10)) AS digest FROM d""")
def normalized_texts(spark, folder):
    rows = _t(spark, folder, "documents").select("doc_id", "text").filter("text is not null")
    return rows.select("doc_id", F.sha1(textual.normalize(F.col("text"))).alias("digest"))


_HEADINGS_SQL = r"""regexp_extract_all({masked}, '(?m)^(#{{1,6}})[ \t]+(.+?)[ \t]*$')""".format(masked=_MASKED_SQL)


@_register(rf"""WITH h AS (SELECT DISTINCT doc_id, {_HEADINGS_SQL} AS hs FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(hs) + 1)) AS i, hs FROM h)
SELECT doc_id, (i - 1)::INT AS position, len(regexp_extract(hs[i], '^#+'))::INT AS level, regexp_replace(regexp_replace(hs[i], '^#+[ \t]+', ''), '^\s+|\s+$', '', 'g') AS title FROM u""")
def document_headings(spark, folder):
    rows = _t(spark, folder, "documents").filter("text is not null").select("doc_id", "text")
    return rows.select("doc_id", F.posexplode(textual.headings(F.col("text"))).alias("position", "h")).select("doc_id", "position", "h.level", "h.title")


@_register("SELECT lang, label, count(*) AS docs FROM (SELECT DISTINCT doc_id, lang, text, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in textual.SCRIPTS) + " WHEN text IS NOT NULL THEN 'en' END AS label FROM documents) GROUP BY ALL")
def script_by_lang(spark, folder):
    rows = _t(spark, folder, "documents").select("doc_id", "lang", "text")
    return rows.groupBy("lang", textual.script_label(F.col("text")).alias("label")).agg(F.count("*").alias("docs"))


@_register(rf"""WITH {_DOCS_SQL}, r AS (SELECT corpus, len(regexp_extract_all(text, {_fixed(TOKEN)})) AS tokens, len({_HEADINGS_SQL}) AS h, len(regexp_extract_all(text, '(?s)```.*?```')) AS c,
 len(list_filter(string_split({_MASKED_SQL}, chr(10)), lambda x: contains(x, '|') AND regexp_matches(x, {_fixed(textual.SEPARATOR_ROW)}))) AS t FROM docs WHERE text IS NOT NULL)
SELECT corpus, count(*) AS docs, sum(tokens)::BIGINT AS tokens, min(tokens)::BIGINT AS min_tokens, quantile_cont(tokens, 0.5) AS p50_tokens, quantile_cont(tokens, 0.95) AS p95_tokens, max(tokens)::BIGINT AS max_tokens,
 sum(h)::BIGINT AS headings, sum(c)::BIGINT AS code_blocks, sum(t)::BIGINT AS tables, round(CASE WHEN sum(tokens) > 0 THEN sum(h) * 1000.0::DOUBLE / sum(tokens) ELSE 0 END, 6) AS headings_per_1k FROM r GROUP BY corpus""")
def corpus_stats(spark, folder):
    rows = stats.corpus_stats(_docs(spark, folder).filter("text is not null"), key="doc_id")
    return rows.select(
        "corpus", "docs", *(F.col(c).cast("long").alias(c) for c in ("tokens", "min_tokens")), "p50_tokens", "p95_tokens",
        *(F.col(c).cast("long").alias(c) for c in ("max_tokens", "headings", "code_blocks", "tables")), "headings_per_1k",
    )


@_register(f"WITH {_DOCS_SQL} SELECT corpus, label, count(*) AS docs FROM (SELECT corpus, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in textual.SCRIPTS) + " ELSE 'en' END AS label FROM docs WHERE text IS NOT NULL) GROUP BY ALL")
def language_mix(spark, folder):
    return stats.language_mix(_docs(spark, folder).filter("text is not null"), key="doc_id")


@_register(rf"""WITH {_DOCS_SQL}, s AS (SELECT doc_id, regexp_replace(string_split(source_path, '/')[-1], '\.[^.]*$', '') AS stem FROM docs WHERE source_path IS NOT NULL),
w AS (SELECT doc_id, stem, array_to_string(list_transform(list_filter(string_split_regex(stem, '[-_]+'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS t FROM s)
SELECT doc_id, CASE WHEN t = '' THEN stem ELSE t END AS title FROM w""")
def humanized_titles(spark, folder):
    stem = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), r"\.[^.]*$", "")
    return _docs(spark, folder).filter("source_path is not null").select("doc_id", textual.humanized(stem).alias("title")).distinct()


@_register(r"""WITH c AS (SELECT DISTINCT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE substring(t, 1, 59) || '…' END AS preview FROM c""")
def previews(spark, folder):
    return _t(spark, folder, "documents").filter("text is not null").select("doc_id", "text").select("doc_id", textual.preview(F.col("text")).alias("preview"))


@_register(r"SELECT corpus, count(*) AS queries, sum(CASE WHEN regexp_matches(query, '\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b') THEN 1 ELSE 0 END)::BIGINT AS with_identifier FROM (SELECT DISTINCT query_id, corpus, query FROM evalset WHERE query IS NOT NULL) GROUP BY corpus")
def identifier_queries(spark, folder):
    rows = _t(spark, folder, "evalset").filter("query is not null").select("query_id", "corpus", "query").distinct()
    return rows.groupBy("corpus").agg(F.count("*").alias("queries"), F.sum(textual.has_identifier(F.col("query")).cast("long")).alias("with_identifier"))


# --- ids ---


@_register("SELECT DISTINCT doc_id, substring(sha1(corpus || chr(0) || replace(source_path, '\\', '/') || chr(0)), 1, 12) AS made_id FROM corpus_docs")
def doc_ids(spark, folder):
    return _t(spark, folder, "corpus_docs").select("doc_id", ids.doc_id(F.col("corpus"), F.col("source_path")).alias("made_id")).distinct()


@_register("""WITH q AS (SELECT DISTINCT query_id FROM evalset), s AS (SELECT query_id, ('0x' || substring(sha1(query_id || chr(0)), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS x FROM q)
SELECT query_id, CASE WHEN x < 0.6 THEN 'train' WHEN x < 0.8 THEN 'dev' WHEN x IS NOT NULL THEN 'test' END AS split FROM s""")
def query_splits(spark, folder):
    return _t(spark, folder, "evalset").select("query_id").distinct().select("query_id", ids.split_of(F.col("query_id")).alias("split"))


@_register("""SELECT DISTINCT query_id, substring(sha1(corpus || chr(0) || gold_doc_id || chr(0) || array_to_string(list_transform(gold_char_spans, lambda s: s[1]::VARCHAR || chr(0) || s[2]::VARCHAR || chr(0)), '') || query || chr(0)), 1, 16) AS made_id
FROM evalset WHERE query IS NOT NULL AND gold_doc_id IS NOT NULL AND corpus IS NOT NULL AND gold_char_spans IS NOT NULL""")
def query_ids(spark, folder):
    rows = _t(spark, folder, "evalset").filter("query is not null and gold_doc_id is not null and corpus is not null and gold_char_spans is not null")
    return rows.select("query_id", ids.query_id(F.col("corpus"), F.col("gold_doc_id"), F.col("gold_char_spans"), F.col("query")).alias("made_id")).distinct()


@_register(f"SELECT split, corpus, count(*) AS pairs FROM (SELECT DISTINCT query_id, {_SPLIT_SQL} AS split, corpus FROM evalset) GROUP BY ALL")
def evalset_counts(spark, folder):
    rows = _t(spark, folder, "evalset").select("query_id", labels.split_name(F.col("split")).alias("split"), "corpus").distinct()
    return rows.groupBy("split", "corpus").agg(F.count("*").alias("pairs"))


# --- chunkers ---


_FIXED_SQL = f"""p AS (SELECT DISTINCT doc_id, regexp_extract_all(text, {_fixed(PIECE)}) AS p FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, unnest(range(0, greatest(ceil((len(p) - 128) / 96.0), 0)::BIGINT + 1)) AS i FROM p WHERE len(p) > 0),
f AS (SELECT doc_id, i, length(array_to_string(p[1:i * 96], '')) AS s, array_to_string(p[i * 96 + 1:i * 96 + 128], '') AS t, len(p[i * 96 + 1:i * 96 + 128]) AS n FROM w)"""


@_register(f"WITH {_FIXED_SQL} SELECT doc_id, i::INT AS ordinal, s::INT AS char_start, (s + length(t))::INT AS char_end, n::INT AS token_count, sha1(t) AS digest FROM f")
def fixed_chunks(spark, folder):
    rows = chunkers.specs(_texts(spark, folder), "fixed", {"chunk_tokens": 128, "overlap_tokens": 32})
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ordinal", "char_start", "char_end", "token_count", F.sha1("text").alias("digest"))


_FIXED_SIGN = ids.signature("fixed", chunkers.resolve("fixed", {"chunk_tokens": 128, "overlap_tokens": 32}))


@_register(f"WITH {_FIXED_SQL} SELECT substring(sha1(doc_id::VARCHAR || chr(0) || s::VARCHAR || chr(0) || (s + length(t))::VARCHAR || chr(0) || '{_FIXED_SIGN}' || chr(0)), 1, 16) AS chunk_id, doc_id::VARCHAR AS doc_id, i::INT AS ordinal FROM f")
def fixed_chunk_ids(spark, folder):
    return chunkers.chunk(_texts(spark, folder), "fixed", {"chunk_tokens": 128, "overlap_tokens": 32}).select("chunk_id", "doc_id", "ordinal")


_WORD = "\\p{L}\\p{N}_"
_TAIL = f"[.!?]+[\"''’”)]*[{_SPACES}]+"
_MARK = "\ue000"  # stands in no text here
_TEXTS_SQL = "texts AS (SELECT DISTINCT doc_id, corpus, text FROM corpus_docs WHERE text <> '')"
# parts end wherever a sentence may end; a part that ends in a one-letter word or an abbreviation goes on in the next
_SENTENCES_SQL = f"""marked AS (SELECT doc_id, string_split(regexp_replace(text, '({_TAIL})([A-Z0-9\"''‘“(#`\\-*>|])', '\\1{_MARK}\\2', 'g'), '{_MARK}') AS p FROM texts),
parts AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p FROM marked),
ends AS (SELECT doc_id, i, len(p) AS k, length(array_to_string(p[1:i], '')) AS edge, regexp_matches(p[i], '(^|[^{_WORD}])([{_WORD}]|(?i:{"|".join(sentences.ABBREVIATIONS)})){_TAIL}$') AS goes_on FROM parts),
edges AS (SELECT DISTINCT doc_id, edge FROM ends WHERE i = k OR NOT goes_on UNION SELECT doc_id, 0 FROM texts),
sents AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS n FROM (SELECT doc_id, lag(edge) OVER (PARTITION BY doc_id ORDER BY edge) AS a, edge AS b FROM edges) WHERE a IS NOT NULL)"""
# spans of fenced blocks and of tables, from what lies between them and from stretches of lines with pipes
_REGIONS_SQL = f"""blocks AS (SELECT doc_id, string_split_regex(text, '(?s)```.*?```') AS o, regexp_extract_all(text, '(?s)```.*?```') AS f FROM texts),
fences AS (SELECT doc_id, a, a + length(f[i]) AS b FROM (SELECT doc_id, f, unnest(range(1, len(f) + 1)) AS i, length(array_to_string(o[1:unnest(range(1, len(f) + 1))], '')) + length(array_to_string(f[1:unnest(range(1, len(f) + 1)) - 1], '')) AS a FROM blocks)),
lines AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, t, m FROM (SELECT doc_id, string_split(text, chr(10)) AS t, string_split({_MASKED_SQL}, chr(10)) AS m FROM texts)),
piped AS (SELECT doc_id, i, length(array_to_string(t[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS a, length(t[i]) AS n, regexp_matches(m[i], {_fixed(textual.SEPARATOR_ROW)}) AS rule, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM lines WHERE contains(m[i], '|')),
tables AS (SELECT doc_id, min(a) AS a, max(a + n) AS b FROM piped GROUP BY doc_id, island HAVING bool_or(rule))"""


def _chunk_rows_sql(name: str, over: dict, spans: str) -> str:
    """The rows of a chunker query from spans (doc_id, n, a, b, and embed: the text to embed, null for the chunk's own)."""
    sign = ids.signature(name, chunkers.resolve(name, over))
    return f"""SELECT DISTINCT substring(sha1(doc_id || chr(0) || a::VARCHAR || chr(0) || b::VARCHAR || chr(0) || '{sign}' || chr(0)), 1, 16) AS chunk_id, doc_id, n::INT AS ordinal, a::INT AS char_start, b::INT AS char_end,
 len(regexp_extract_all(t, {_fixed(TOKEN)}))::INT AS token_count, sha1(t) AS digest, sha1(coalesce(embed, t)) AS embed_digest FROM (SELECT s.*, substring(text, a::BIGINT + 1, (b - a)::BIGINT) AS t FROM ({spans}) s JOIN texts USING (doc_id))"""


_WINDOW_SQL = f"""WITH {_TEXTS_SQL}, {_SENTENCES_SQL} """ + _chunk_rows_sql("sentence_window", {}, """SELECT doc_id, n, first_value(s.a) OVER near AS a, last_value(s.b) OVER near AS b, substring(text, s.a::BIGINT + 1, (s.b - s.a)::BIGINT) AS embed
 FROM sents s JOIN texts USING (doc_id) WINDOW near AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
_PARAGRAPH_SQL = f"""WITH {_TEXTS_SQL}, cut AS (SELECT doc_id, string_split_regex(text, '\\n[{_SPACES}]*\\n') AS p, regexp_extract_all(text, '\\n[{_SPACES}]*\\n') AS g FROM texts),
piece AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p, g FROM cut),
spans AS (SELECT doc_id, i, length(array_to_string(p[1:i - 1], '')) + length(array_to_string(g[1:i - 1], '')) AS a, length(regexp_replace(p[i], '[{_SPACES}]+$', '')) AS size FROM piece),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM spans WHERE size > 0),
grp AS (SELECT *, sum(CASE WHEN r = 1 OR size >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM kept) """ + _chunk_rows_sql("paragraph", {}, "SELECT doc_id, n - 1 AS n, min(a) AS a, max(a + size) AS b, NULL::VARCHAR AS embed FROM grp GROUP BY doc_id, n")


def _split_sql(at: str, source: str, to: str, sep: str, budget: int) -> str:
    """Pieces of `source` over the budget split at a separator, which stays with the piece before; the others as they are."""
    mark = f"'{sep}'".replace("\n", "' || chr(10) || '").replace("'' || ", "").replace(" || ''", "")
    cut = f"len(regexp_extract_all(substring(text, a::BIGINT + 1, (b - a)::BIGINT), {_fixed(TOKEN)}))"
    return f"""{to}t AS (SELECT doc_id, g, a, b, {at}, string_split(substring(text, a::BIGINT + 1, (b - a)::BIGINT), {mark}) AS p FROM {source} JOIN texts USING (doc_id) WHERE n > {budget}),
{to}u AS (SELECT doc_id, g, a + length(array_to_string(p[1:i - 1], {mark})) + CASE WHEN i > 1 THEN {len(sep)} ELSE 0 END AS a, CASE WHEN i = len(p) THEN b ELSE a + length(array_to_string(p[1:i], {mark})) + {len(sep)} END AS b FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM {to}t)),
{to} AS (SELECT * FROM {source} WHERE n <= {budget} UNION ALL SELECT doc_id, g, a, b, {cut} AS n FROM {to}u JOIN texts USING (doc_id) WHERE b > a)"""


def _recursive_sql(roots: str, budget: int, overlap: int) -> str:
    """Common table expressions up to `packs` (doc_id, g, i, a, b): the spans that recursive splitting gives for each root (doc_id, g, a, b)."""
    count = f"len(regexp_extract_all(substring(text, a::BIGINT + 1, (b - a)::BIGINT), {_fixed(TOKEN)}))"
    kept = lambda x: f"coalesce(list_sum(s[{x}:k - 1]), 0)"
    return f"""roots AS ({roots}), l0 AS (SELECT doc_id, g, a, b, {count} AS n FROM roots JOIN texts USING (doc_id)),
{_split_sql('n', 'l0', 'l1', chr(10) * 2, budget)}, {_split_sql('n', 'l1', 'l2', chr(10), budget)}, {_split_sql('n', 'l2', 'l3', '. ', budget)}, {_split_sql('n', 'l3', 'l4', ' ', budget)},
wp AS (SELECT doc_id, g, a, b, regexp_extract_all(substring(text, a::BIGINT + 1, (b - a)::BIGINT), {_fixed(PIECE)}) AS p FROM l4 JOIN texts USING (doc_id) WHERE n > {budget}),
wi AS (SELECT *, unnest(range(0, ceil(len(p) / {budget}.0)::BIGINT)) AS i FROM wp),
pieces AS (SELECT doc_id, g, a, b, n FROM l4 WHERE n <= {budget} UNION ALL SELECT doc_id, g, a + length(array_to_string(p[1:i * {budget}], '')) AS a, least(b, a + length(array_to_string(p[1:(i + 1) * {budget}], ''))) AS b, len(p[i * {budget} + 1:(i + 1) * {budget}]) AS n FROM wi),
lists AS (SELECT doc_id, g, list(a ORDER BY a, b) AS x, list(b ORDER BY a, b) AS y, list(n ORDER BY a, b) AS s FROM pieces GROUP BY doc_id, g),
pack(doc_id, g, k, f, total, done) AS (SELECT doc_id, g, 0::BIGINT, 1::BIGINT, 0::HUGEINT, []::STRUCT(a BIGINT, b BIGINT)[] FROM lists
 UNION ALL SELECT doc_id, g, k, CASE WHEN full_ THEN CASE WHEN again THEN k ELSE c END ELSE f END, (CASE WHEN full_ THEN CASE WHEN again THEN 0 ELSE {kept('c')} END ELSE total END + s[k])::HUGEINT,
  CASE WHEN full_ THEN list_concat(done, [{{'a': x[f]::BIGINT, 'b': y[k - 1]::BIGINT}}], CASE WHEN again THEN [{{'a': x[c]::BIGINT, 'b': y[k - 1]::BIGINT}}] ELSE [] END) ELSE done END
 FROM (SELECT *, full_ AND k > c AND {kept('c')} + s[k] > {budget} AS again
  FROM (SELECT *, CASE WHEN k - d > 1 AND {kept('d')} + s[k] > {budget} THEN list_filter(range(d, k), lambda q: coalesce(list_sum(s[q:k - 1]), 0) + s[k] <= {budget} OR q = k - 1)[1] ELSE d END AS c
   FROM (SELECT *, CASE WHEN k - f > 1 THEN list_filter(range(f, k + 1), lambda q: coalesce(list_sum(s[q:k - 1]), 0) <= {overlap})[1] ELSE k END AS d
    FROM (SELECT r.doc_id, r.g, r.k + 1 AS k, r.f, r.total, r.done, x, y, s, r.k + 1 > r.f AND r.total + s[r.k + 1] > {budget} AS full_ FROM pack r JOIN lists l ON l.doc_id = r.doc_id AND l.g = r.g WHERE r.k < len(s)))))),
whole AS (SELECT p.doc_id, p.g, list_append(done, {{'a': x[f]::BIGINT, 'b': y[k]::BIGINT}}) AS o FROM pack p JOIN lists l ON l.doc_id = p.doc_id AND l.g = p.g WHERE p.k = len(s)),
packs AS (SELECT doc_id, g, i, o[i].a AS a, o[i].b AS b FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM whole))"""


_RECURSIVE_OVER, _TABLE_OVER = {"chunk_tokens": 128, "overlap_tokens": 16}, {"fallback_chunk_tokens": 128}
_RECURSIVE_SQL = f"WITH RECURSIVE {_TEXTS_SQL}, {_recursive_sql('SELECT doc_id, 0 AS g, 0::BIGINT AS a, length(text) AS b FROM texts', 128, 16)} " + _chunk_rows_sql(
    "recursive", _RECURSIVE_OVER, "SELECT doc_id, i - 1 AS n, a, b, NULL::VARCHAR AS embed FROM packs",
)
_GAPS = f"""SELECT doc_id, g, a, b FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS g, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a, s AS b
 FROM (SELECT doc_id, a AS s, b FROM tables UNION ALL SELECT doc_id, length(text), length(text) + 1 FROM texts)) JOIN texts USING (doc_id) WHERE b > a AND regexp_matches(substring(text, a::BIGINT + 1, (b - a)::BIGINT), '[^{_SPACES}]')"""
_PROMPT = "'" + chunkers.summary_prompt("@", 150).replace("'", "''").replace("\n", "' || chr(10) || '").replace("@", "' || t || '") + "'"
_TABLE_SQL = f"WITH RECURSIVE {_TEXTS_SQL}, {_REGIONS_SQL}, {_recursive_sql(_GAPS, 128, 0)} " + _chunk_rows_sql("table_summary", _TABLE_OVER, f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS n, a, b, embed FROM (SELECT doc_id, a, b, NULL::VARCHAR AS embed FROM packs
 UNION ALL SELECT doc_id, a, b, '[mock-llm] ' || substring(sha1({_PROMPT}), 1, 12) || chr(10) || chr(10) || t FROM (SELECT doc_id, a, b, substring(text, a::BIGINT + 1, (b - a)::BIGINT) AS t FROM tables JOIN texts USING (doc_id)))""")


def _chunker_query(name: str, over: dict, sql: str | None) -> None:
    def query(spark, folder):
        rows = chunkers.chunk(_docs(spark, folder), name, over)
        return rows.select(
            "chunk_id", "doc_id", "ordinal", "char_start", "char_end", "token_count", F.sha1("text").alias("digest"),
            F.sha1("embed_text").alias("embed_digest"),
        ).distinct()

    query.__name__ = f"{name}_chunks"
    _register(sql)(query)


_CHUNKER_QUERIES = (
    ("recursive", _RECURSIVE_OVER, _RECURSIVE_SQL), ("markdown", {"max_tokens": 256, "min_tokens": 32}, None), ("sentence_window", {}, _WINDOW_SQL),
    ("semantic", {}, None), ("table_summary", _TABLE_OVER, _TABLE_SQL), ("paragraph", {}, _PARAGRAPH_SQL),
)
for _name, _over, _sql in _CHUNKER_QUERIES:
    _chunker_query(_name, _over, _sql)


_CHECKS_SQL = f"SELECT DISTINCT doc_id, length(regexp_replace(text, '[{_SPACES}]', '', 'g'))::INT AS n_signs, length(regexp_replace(text, '[{_SPACES}]', '', 'g'))::INT AS covered_signs, 0::BIGINT AS wrong FROM corpus_docs WHERE text <> ''"


def _check_query(name: str, over: dict) -> None:
    def query(spark, folder):
        docs = _docs(spark, folder).filter("text != ''")
        return stats.chunk_checks(chunkers.specs(docs, name, over), docs)

    query.__name__ = f"{name}_chunk_checks"
    _register(_CHECKS_SQL)(query)


for _name, _over in (("markdown", {"max_tokens": 256, "min_tokens": 32}), ("semantic", {})):
    _check_query(_name, _over)


@_register(f"""WITH {_CHUNKS_SQL} SELECT chunk_set_id, count(*) AS chunks, min(token_count) AS min_tokens, quantile_cont(token_count, 0.5) AS p50_tokens, quantile_cont(token_count, 0.95) AS p95_tokens, max(token_count) AS max_tokens,
 round(avg(CASE WHEN token_count < 32 THEN 1.0::DOUBLE WHEN token_count IS NOT NULL THEN 0.0::DOUBLE END), 6) AS orphan_rate, count(DISTINCT doc_id) AS docs FROM chunks GROUP BY chunk_set_id""")
def delivered_chunk_sizes(spark, folder):
    rows = _chunks(spark, folder, "chunk_id", "ordinal", "chunk_set_id", "doc_id", "token_count").groupBy("chunk_set_id")
    return rows.agg(
        F.count("*").alias("chunks"), F.min("token_count").alias("min_tokens"), *stats.percentiles("token_count"),
        F.max("token_count").alias("max_tokens"),
        F.round(F.avg((F.col("token_count") < stats.ORPHAN_TOKENS).cast("double")), 6).alias("orphan_rate"),
        F.countDistinct("doc_id").alias("docs"),
    )


@_register(f"""WITH {_TEXTS_SQL}, {_SENTENCES_SQL}, {_REGIONS_SQL},
c AS (SELECT DISTINCT chunk_set_id, doc_id, chunk_id, ordinal, char_start, char_end, token_count, len(heading_path) AS depth FROM chunks_child),
sizes AS (SELECT DISTINCT doc_id, length(text) AS n FROM texts),
cut AS (SELECT c.*, coalesce((char_start > 0 AND char_start < n AND s.edge IS NULL) OR (char_end > 0 AND char_end < n AND e.edge IS NULL), false) AS cut
 FROM c LEFT JOIN sizes USING (doc_id) LEFT JOIN edges s ON s.doc_id = c.doc_id AND s.edge = char_start LEFT JOIN edges e ON e.doc_id = c.doc_id AND e.edge = char_end),
sets AS (SELECT DISTINCT chunk_set_id, doc_id FROM c), pts AS (SELECT DISTINCT chunk_set_id, doc_id, unnest([char_start, char_end]) AS p FROM c),
f AS (SELECT chunk_set_id, count(*) AS fences, sum(CASE WHEN EXISTS (SELECT 1 FROM pts WHERE pts.chunk_set_id = s.chunk_set_id AND pts.doc_id = s.doc_id AND pts.p > r.a AND pts.p < r.b) THEN 1 ELSE 0 END) AS split_fences FROM sets s JOIN fences r USING (doc_id) GROUP BY chunk_set_id),
t AS (SELECT chunk_set_id, count(*) AS tables, sum(CASE WHEN EXISTS (SELECT 1 FROM pts WHERE pts.chunk_set_id = s.chunk_set_id AND pts.doc_id = s.doc_id AND pts.p > r.a AND pts.p < r.b) THEN 1 ELSE 0 END) AS split_tables FROM sets s JOIN tables r USING (doc_id) GROUP BY chunk_set_id),
g AS (SELECT chunk_set_id, count(*) AS chunks, min(token_count) AS min_tokens, quantile_cont(token_count, 0.5) AS p50_tokens, quantile_cont(token_count, 0.95) AS p95_tokens, max(token_count) AS max_tokens,
 round(avg(cut::INT::DOUBLE), 6) AS split_sentence_rate, round(avg(depth::DOUBLE), 6) AS mean_heading_depth, round(avg(CASE WHEN token_count < 32 THEN 1.0::DOUBLE WHEN token_count IS NOT NULL THEN 0.0::DOUBLE END), 6) AS orphan_rate, count(DISTINCT doc_id) AS docs FROM cut GROUP BY chunk_set_id)
SELECT g.*, coalesce(fences, 0)::BIGINT AS fences, coalesce(split_fences, 0)::BIGINT AS split_fences, coalesce(tables, 0)::BIGINT AS tables, coalesce(split_tables, 0)::BIGINT AS split_tables, NULL::DOUBLE AS build_seconds
FROM g LEFT JOIN f USING (chunk_set_id) LEFT JOIN t USING (chunk_set_id)""")
def delivered_chunk_stats(spark, folder):
    rows = _t(spark, folder, "chunks_child").select(
        "chunk_set_id", "doc_id", "chunk_id", "ordinal", "char_start", "char_end", "token_count", F.size("heading_path").alias("depth"),
    ).distinct()
    return stats.chunk_stats(rows, _docs(spark, folder).filter("text is not null").dropDuplicates(["doc_id"]))


@_register(f"""WITH {_CHUNKS_SQL} SELECT doc_id, chunk_set_id, ordinal, greatest(coalesce(lag(char_end) OVER (PARTITION BY chunk_set_id, doc_id ORDER BY char_start, char_end, ordinal) - char_start, 0), 0)::INT AS shared
FROM (SELECT DISTINCT doc_id, chunk_set_id, ordinal, char_start, char_end FROM chunks)""")
def chunk_overlaps(spark, folder):
    rows = _chunks(spark, folder, "doc_id", "chunk_set_id", "ordinal", "char_start", "char_end")
    return relations.overlap_with_previous(rows).select("doc_id", "chunk_set_id", "ordinal", "shared")


@_register(f"""WITH {_DOCS_SQL}, {_CHUNKS_SQL}, s AS (SELECT DISTINCT doc_id, char_start, char_end FROM chunks),
m AS (SELECT doc_id, greatest(char_start, coalesce(max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a, char_end AS b FROM s),
t AS (SELECT doc_id, sum(least(b, length(text)) - a) AS covered, sum(length(regexp_replace(substring(text, a + 1, b - a), '[{_SPACES}]', '', 'g'))) AS signs FROM m JOIN (SELECT DISTINCT doc_id, text FROM docs) USING (doc_id) WHERE b > a GROUP BY doc_id),
d AS (SELECT DISTINCT doc_id, length(text) AS n, length(regexp_replace(text, '[{_SPACES}]', '', 'g')) AS k FROM docs WHERE text IS NOT NULL)
SELECT doc_id, n::INT AS n_chars, coalesce(covered, 0)::INT AS covered, k::INT AS n_signs, coalesce(signs, 0)::INT AS covered_signs, CASE WHEN k > 0 THEN round(coalesce(signs, 0)::DOUBLE / k, 6) ELSE 1.0::DOUBLE END AS ratio FROM d LEFT JOIN t USING (doc_id)""")
def chunk_coverage(spark, folder):
    return relations.coverage(_chunks(spark, folder, "doc_id", "char_start", "char_end"), _docs(spark, folder))


# --- joins ---


@_register(f"""WITH {_CHUNKS_SQL}, parents AS (SELECT DISTINCT chunk_id, doc_id, char_start, char_end FROM chunks_parent),
j AS (SELECT c.chunk_id, c.doc_id, c.ordinal, p.chunk_id AS pid, row_number() OVER (PARTITION BY c.doc_id, c.ordinal, c.chunk_id ORDER BY p.char_end - p.char_start, p.char_start, p.chunk_id) AS r
 FROM chunks c JOIN parents p ON p.doc_id = c.doc_id AND p.char_start <= (c.char_start + c.char_end) / 2.0 AND (c.char_start + c.char_end) / 2.0 < p.char_end)
SELECT c.chunk_id, c.doc_id, c.ordinal, j.pid AS parent_id FROM (SELECT DISTINCT chunk_id, doc_id, ordinal FROM chunks) c LEFT JOIN j ON j.chunk_id = c.chunk_id AND j.ordinal = c.ordinal AND j.r = 1""")
def parent_assignment(spark, folder):
    rows = relations.assign_parents(
        _chunks(spark, folder, "chunk_id", "doc_id", "ordinal", "char_start", "char_end"),
        _chunks(spark, folder, "chunk_id", "doc_id", "char_start", "char_end", table="chunks_parent"),
    )
    return rows.select("chunk_id", "doc_id", "ordinal", "parent_id")


_GOLD_SQL = """spans AS (SELECT query_id, gold_doc_id AS doc_id, unnest(range(1, len(gold_char_spans) + 1)) AS n, gold_char_spans FROM pairs),
sp AS (SELECT query_id, doc_id, (n - 1)::INT AS span_no, gold_char_spans[n][1] AS s, gold_char_spans[n][2] AS e FROM spans),
gold AS (SELECT DISTINCT query_id, span_no, chunk_id FROM sp JOIN chunks USING (doc_id) WHERE s < char_end AND char_start < e AND e > s AND char_end > char_start
 AND ((least(e, char_end) - greatest(s, char_start))::DOUBLE / (e - s) >= 0.5 OR (least(e, char_end) - greatest(s, char_start))::DOUBLE / (char_end - char_start) >= 0.5))"""


@_register(f"WITH {_CHUNKS_SQL}, {_PAIRS_SQL}, {_GOLD_SQL} SELECT query_id, span_no, chunk_id FROM gold")
def gold_resolution(spark, folder):
    return relations.resolve_gold(_pairs(spark, folder), _chunks(spark, folder, "doc_id", "chunk_id", "char_start", "char_end"))


@_register(f"""WITH {_DOCS_SQL}, e AS (SELECT DISTINCT query_id, corpus, query, list_filter(supporting_quotes, lambda q: q IS NOT NULL AND q <> '') AS q FROM evalset WHERE query_id IS NOT NULL AND query IS NOT NULL),
h AS (SELECT e.query_id, d.doc_id, row_number() OVER (PARTITION BY e.query_id, e.corpus ORDER BY d.source_path, d.doc_id) AS r FROM e JOIN docs d ON d.corpus = e.corpus AND len(list_filter(e.q, lambda x: NOT contains(d.text, x))) = 0 WHERE len(e.q) > 0)
SELECT query_id AS needle_id, doc_id AS gold_doc_id FROM h WHERE r = 1""")
def needle_hosts(spark, folder):
    needles = _t(spark, folder, "evalset").filter("query_id is not null and query is not null").select(
        F.col("query_id").alias("needle_id"), "corpus", "query", F.col("supporting_quotes").alias("needles"),
    ).distinct()
    return relations.needle_evalset(_docs(spark, folder), needles).select("needle_id", "gold_doc_id")


# --- retrieval ---


_BM25_AT = """words AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM (SELECT DISTINCT chunk_id, text FROM chunks)),
terms AS (SELECT chunk_id, term, count(*) AS tf, max(dl) AS dl FROM (SELECT chunk_id, unnest(w) AS term, len(w) AS dl FROM words) GROUP BY chunk_id, term),
totals AS (SELECT count(*) AS n, avg(len(w))::DOUBLE AS avgdl FROM words),
raw AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS x FROM (SELECT term, count(*) AS df FROM terms GROUP BY term), totals),
idf AS (SELECT term, CASE WHEN x < 0 THEN (SELECT avg(x) * 0.25::DOUBLE FROM raw) ELSE x END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS term FROM (SELECT DISTINCT query_id, query FROM pairs)) GROUP BY ALL),
scores AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * qtf), 6) AS score FROM terms JOIN asked USING (term) JOIN idf USING (term), totals GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scores),
fill AS (SELECT q.query_id, c.chunk_id, 0.0::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM pairs) q, (SELECT DISTINCT chunk_id FROM chunks ORDER BY 1 LIMIT 2 * @) c WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = q.query_id AND b.chunk_id = c.chunk_id AND b.r <= @)
 AND (SELECT count(*) FROM best b WHERE b.query_id = q.query_id AND b.r <= @) < @),
hits AS (SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, score FROM best WHERE r <= @ UNION ALL SELECT * FROM fill)) WHERE rank <= @)"""
_BM25_SQL = _BM25_AT.replace("@", "10")


def _bm25(spark, folder, k=10):
    return retrieval.bm25(_pairs(spark, folder).select("query_id", "query").distinct(), _chunks(spark, folder, "chunk_id", "text"), k)


@_register(f"WITH {_CHUNKS_SQL}, {_PAIRS_SQL}, {_BM25_SQL} SELECT query_id, chunk_id, rank::INT AS rank, score FROM hits")
def bm25_topk(spark, folder):
    return _bm25(spark, folder).select("query_id", "chunk_id", "rank", "score")


@_register(f"WITH {_CHUNKS_SQL}, w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM (SELECT DISTINCT chunk_id, text FROM chunks)) SELECT term, count(*) AS df FROM w GROUP BY term")
def bm25_terms(spark, folder):
    return retrieval.postings(_chunks(spark, folder, "chunk_id", "text")).groupBy("term").agg(F.count("*").alias("df"))


@_register(f"""WITH {_CHUNKS_SQL}, {_PAIRS_SQL}, {_BM25_AT.replace('@', '25')}, b AS (SELECT query_id, parent_id, min(rank) AS rank, count(DISTINCT chunk_id) AS n_children FROM hits JOIN (SELECT DISTINCT chunk_id, parent_id FROM chunks WHERE parent_id IS NOT NULL) USING (chunk_id) GROUP BY ALL)
SELECT query_id, chunk_id, rank, n_children FROM (SELECT query_id, parent_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, parent_id)::INT AS rank, n_children FROM b) WHERE rank <= 5""")
def parent_doc_topk(spark, folder):
    linked, parents = _chunks(spark, folder, "chunk_id", "parent_id"), _chunks(spark, folder, "chunk_id", table="chunks_parent")
    hits = _bm25(spark, folder, 5 * retrieval.RETRIEVERS["parent_doc"]["fanout"])
    return retrieval.to_parents(hits, linked, 5, parents=parents).select("query_id", "chunk_id", "rank", "n_children")


@_register(f"""WITH RECURSIVE {_CHUNKS_SQL}, {_PAIRS_SQL}, {_BM25_AT.replace('@', '30')},
c AS (SELECT h.*, doc_id, char_start AS a, char_end AS b FROM hits h JOIN (SELECT DISTINCT chunk_id, doc_id, char_start, char_end FROM chunks) USING (chunk_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM c),
fold(query_id, i, kept) AS (SELECT query_id, i, [{{'chunk_id': chunk_id, 'score': score, 'd': doc_id, 'a': a, 'b': b}}] FROM o WHERE i = 1
 UNION ALL SELECT f.query_id, o.i, CASE WHEN len(list_filter(kept, lambda y: y.d = o.doc_id AND least(y.b - y.a, o.b - o.a) > 0 AND (least(y.b, o.b) - greatest(y.a, o.a))::DOUBLE / least(y.b - y.a, o.b - o.a) > 0.5)) > 0 THEN kept
 ELSE list_append(kept, {{'chunk_id': o.chunk_id, 'score': o.score, 'd': o.doc_id, 'a': o.a, 'b': o.b}}) END FROM fold f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1),
done AS (SELECT query_id, kept FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1),
each AS (SELECT query_id, kept, unnest(range(1, least(len(kept), 10) + 1)) AS r FROM done)
SELECT query_id, kept[r].chunk_id AS chunk_id, r::INT AS rank, kept[r].score AS score FROM each""")
def window_dedup_topk(spark, folder):
    return retrieval.without_overlaps(
        _bm25(spark, folder, 30), _chunks(spark, folder, "chunk_id", "doc_id", "char_start", "char_end"), 10,
    ).select("query_id", "chunk_id", "rank", "score")


def _vectors(spark, folder):
    rows = _t(spark, folder, "embeddings")
    asked = rows.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), vectors.doubles(F.col("embedding")).alias("vector"))
    return asked, rows.select(F.col("vec_id").alias("chunk_id"), vectors.doubles(F.col("embedding")).alias("embedding"), "label")


def _dense_sql(dims: str = "", extra: str = "", name: str = "d", depth: int = 10) -> str:
    v = f"embedding{dims}::DOUBLE[]"
    return f"""{name}v AS (SELECT vec_id, label, {v} AS v, sqrt(list_dot_product({v}, {v})) AS n FROM embeddings),
{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v) / (q.n * c.n), 6) + 0.0 AS score FROM {name}v q, {name}v c WHERE q.vec_id % 20 = 0 {extra}) QUALIFY rank <= {depth})"""


@_register(f"WITH {_dense_sql()} SELECT query_id, chunk_id, rank, score FROM d")
def dense_topk(spark, folder):
    asked, store = _vectors(spark, folder)
    return retrieval.dense(asked, store, 10).select("query_id", "chunk_id", "rank", "score")


@_register(f"WITH {_dense_sql('', 'AND c.label = 3')} SELECT query_id, chunk_id, rank, score FROM d")
def dense_label_topk(spark, folder):
    asked, store = _vectors(spark, folder)
    return retrieval.dense(asked, store.filter("label = 3"), 10).select("query_id", "chunk_id", "rank", "score")


def _short(frame: DataFrame, name: str) -> DataFrame:
    return frame.withColumn(name, vectors.truncated(F.col(name), 16))


@_register(f"WITH {_dense_sql('[1:16]')} SELECT query_id, chunk_id, rank, score FROM d")
def truncated_dense_topk(spark, folder):
    asked, store = _vectors(spark, folder)
    return retrieval.dense(_short(asked, "vector"), _short(store, "embedding"), 10).select("query_id", "chunk_id", "rank", "score")


@_register(f"""WITH {_dense_sql(depth=50)}, {_dense_sql('[1:16]', name='t', depth=50)}, f AS (SELECT query_id, chunk_id, round(sum(x), 9) AS score FROM (SELECT query_id, chunk_id, 2.0::DOUBLE / (60 + rank) AS x FROM d UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM t) GROUP BY ALL)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, score FROM f QUALIFY rank <= 10""")
def hybrid_rrf(spark, folder):
    asked, store = _vectors(spark, folder)
    deep = max(retrieval.RETRIEVERS["hybrid"]["candidate_k"], 10)  # cut to 10 only after fusion
    lists = {"whole": retrieval.dense(asked, store, deep), "short": retrieval.dense(_short(asked, "vector"), _short(store, "embedding"), deep)}
    return retrieval.fuse(lists, 10, 60, {"whole": 2.0}).select("query_id", "chunk_id", "rank", "score")


#: Lists of the approximate index, and how many of them a query looks into: these vectors have little structure, 22 lists are two thirds of them for a recall of about 0.95.
ANN_LISTS, ANN_PROBES = 32, 22


@_register("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark, folder):
    """Whether the index of inverted lists, over every vector, finds nine tenths of the exact ten best of each query."""
    asked, store = _vectors(spark, folder)
    centroids = ann.fit_centroids(store, ANN_LISTS)
    got = ann.search(asked, ann.filed(store, centroids), centroids, 10, ANN_PROBES)
    return ann.recall(got, retrieval.dense(asked, store, 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@_register()
def hash_embed_topk(spark, folder):
    chunks = scratch.spread(_t(spark, folder, "chunks_child").select("chunk_id", "embed_text"), "chunk_id").distinct()
    store = scratch.materialize(chunks.select("chunk_id", vectors.embedding(F.col("embed_text"), "hash").alias("embedding")), "hash-index")
    asked = retrieval.embed_queries(_pairs(spark, folder).select("query_id", "query").distinct())
    return retrieval.dense(asked, store, 10).select("query_id", "chunk_id", "rank", "score")


# --- metrics ---


@_register(f"""WITH {_CHUNKS_SQL}, {_PAIRS_SQL}, {_GOLD_SQL}, {_BM25_SQL},
g AS (SELECT query_id, count(DISTINCT chunk_id) AS n FROM gold GROUP BY query_id),
r AS (SELECT h.query_id, h.rank FROM hits h SEMI JOIN gold g ON g.query_id = h.query_id AND g.chunk_id = h.chunk_id),
m AS (SELECT g.query_id, g.n, min(r.rank) AS first, coalesce(sum(1.0::DOUBLE / log2(r.rank + 1.0::DOUBLE)), 0) AS dcg, list_sum(list_transform(range(1, least(g.n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) AS best FROM g LEFT JOIN r USING (query_id) GROUP BY ALL),
size AS (SELECT query_id, sum(coalesce(t, 0)) AS tokens FROM hits JOIN (SELECT chunk_id, max(token_count) AS t FROM chunks GROUP BY 1) USING (chunk_id) GROUP BY 1)
SELECT count(*) AS queries, sum(CASE WHEN m.query_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS excluded, {', '.join(f"round(avg(CASE WHEN m.query_id IS NOT NULL THEN (coalesce(first, 99) <= {d})::INT::DOUBLE END), 6) AS recall_{d}" for d in metrics.RECALL_DEPTHS)},
 round(avg(CASE WHEN m.query_id IS NOT NULL THEN coalesce(1.0::DOUBLE / first, 0) END), 6) AS mrr, round(avg(dcg / best), 6) AS ndcg_10, round(avg(CASE WHEN first IS NOT NULL THEN tokens::DOUBLE END), 6) AS chunk_efficiency
FROM pairs LEFT JOIN m USING (query_id) LEFT JOIN size USING (query_id)""")
def bm25_metrics(spark, folder):
    pairs, chunks = _pairs(spark, folder), _chunks(spark, folder, "chunk_id", "doc_id", "char_start", "char_end", "token_count")
    rows = metrics.traces(pairs, _bm25(spark, folder), relations.resolve_gold(pairs, chunks), chunks, 10)
    return metrics.summary(rows.withColumn("excluded", F.col("excluded").cast("long"))).drop("all_spans_hit")


_TRACES_SQL = """tr AS (SELECT DISTINCT trace_id, run_id, query_id, retrieved_chunk_ids AS ids, gold_chunk_ids AS gold, latency_ms, excluded FROM run_traces),
sc AS (SELECT *, list_filter(range(1, len(ids) + 1), lambda i: list_contains(gold, ids[i])) AS ranks FROM tr),
ms AS (SELECT trace_id, run_id, query_id, latency_ms, excluded, list_min(ranks)::INT AS first, round(CASE WHEN len(gold) > 0 THEN coalesce(list_sum(list_transform(list_filter(ranks, lambda p: p <= 10), lambda p: 1.0::DOUBLE / log2(p + 1.0::DOUBLE))), 0)
 / list_sum(list_transform(range(1, least(len(list_distinct(gold)), 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) END, 6) AS ndcg_10 FROM sc)"""


def _scored_traces(spark, folder):
    rows = _t(spark, folder, "run_traces").select("trace_id", "run_id", "query_id", "retrieved_chunk_ids", "gold_chunk_ids", "latency_ms", "excluded")
    rows = rows.withColumn("ranks", metrics.hit_ranks(F.col("retrieved_chunk_ids"), F.col("gold_chunk_ids")))
    ranks = F.col("ranks")
    recalls = [metrics.recall_at(ranks, d).alias(f"recall_{d}") for d in (1, 5)]
    return rows.select(
        "trace_id", "run_id", "query_id", "latency_ms", "excluded", F.array_min(ranks).alias("first_hit_rank"), *recalls,
        metrics.reciprocal_rank(ranks).alias("mrr"),
        F.round(metrics.ndcg_at(ranks, F.size(F.array_distinct("gold_chunk_ids")), 10), 6).alias("ndcg_10"),
    ).distinct()  # after scoring: no lists are shuffled


@_register(f"WITH {_TRACES_SQL} SELECT trace_id, first AS first_hit_rank, (coalesce(first, 99) <= 1)::INT::DOUBLE AS recall_1, (coalesce(first, 99) <= 5)::INT::DOUBLE AS recall_5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, ndcg_10 FROM ms")
def trace_metrics(spark, folder):
    return _scored_traces(spark, folder).select("trace_id", "first_hit_rank", "recall_1", "recall_5", F.round("mrr", 6).alias("mrr"), "ndcg_10")


@_register(f"""WITH {_TRACES_SQL} SELECT run_id, count(*) AS queries, sum(excluded::INT)::BIGINT AS excluded, round(avg(CASE WHEN NOT excluded THEN (coalesce(first, 99) <= 1)::INT::DOUBLE END), 6) AS recall_1, round(avg(CASE WHEN NOT excluded THEN (coalesce(first, 99) <= 5)::INT::DOUBLE END), 6) AS recall_5,
 round(avg(CASE WHEN NOT excluded THEN coalesce(1.0::DOUBLE / first, 0) END), 6) AS mrr, round(avg(CASE WHEN NOT excluded THEN ndcg_10 END), 6) AS ndcg_10, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95 FROM ms GROUP BY run_id""")
def run_summary(spark, folder):
    rows = _scored_traces(spark, folder)
    scored = lambda c: F.round(F.avg(F.when(~F.col("excluded"), F.col(c))), 6).alias(c)
    return rows.groupBy("run_id").agg(
        F.count("*").alias("queries"), F.sum(F.col("excluded").cast("long")).alias("excluded"), *(scored(c) for c in ("recall_1", "recall_5", "mrr", "ndcg_10")),
        F.round(F.percentile("latency_ms", F.lit(0.5)), 6).alias("latency_p50"), F.round(F.percentile("latency_ms", F.lit(0.95)), 6).alias("latency_p95"),
    )


@_register(f"""WITH {_TRACES_SQL} SELECT trace_id, run_id, query_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY excluded, first IS NOT NULL, CASE WHEN first <= 5 THEN 1 ELSE 0 END, query_id, trace_id) AS r FROM ms) WHERE r <= 20""")
def worst_queries(spark, folder):
    w = Window.partitionBy("run_id").orderBy("excluded", F.col("first_hit_rank").isNotNull(), "recall_5", "query_id", "trace_id")
    return _scored_traces(spark, folder).withColumn("r", F.row_number().over(w)).filter("r <= 20").select("trace_id", "run_id", "query_id")


@_register(f"""WITH {_TRACES_SQL}, q AS (SELECT run_id, query_id, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr FROM ms WHERE NOT excluded GROUP BY ALL),
b AS (SELECT query_id, count(*) AS runs, round(max(mrr) - min(mrr), 6) AS spread FROM q GROUP BY query_id) SELECT query_id, runs, spread FROM b WHERE runs > 1""")
def run_spread(spark, folder):
    """Queries that several runs answered, and how far the runs' reciprocal ranks are apart."""
    one = _scored_traces(spark, folder).filter("not excluded").groupBy("run_id", "query_id").agg(F.avg("mrr").alias("mrr"))
    return one.groupBy("query_id").agg(F.count("*").alias("runs"), F.round(F.max("mrr") - F.min("mrr"), 6).alias("spread")).filter("runs > 1")


@_register()
def bootstrap_ci(spark, folder):
    return metrics.bootstrap(_scored_traces(spark, folder).filter("not excluded"), ["run_id"], "mrr", "trace_id")


@_register(f"""WITH {_TRACES_SQL} SELECT run_id, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mean, true AS holds_mean, true AS normal_width FROM ms WHERE NOT excluded GROUP BY run_id""")
def bootstrap_checks(spark, folder):
    """Whether each run's interval holds its mean and is about as wide as the normal distribution says."""
    rows = _scored_traces(spark, folder).filter("not excluded")
    wide = rows.groupBy("run_id").agg((2 * 1.96 * F.stddev_pop("mrr") / F.sqrt(F.count("*"))).alias("width"))
    found = metrics.bootstrap(rows, ["run_id"], "mrr", "trace_id").join(wide, "run_id")
    return found.select(
        "run_id", "n", F.round("mean", 6).alias("mean"), F.col("mean").between(F.col("low"), F.col("high")).alias("holds_mean"),
        (F.abs((F.col("high") - F.col("low")) / F.col("width") - 1) < 0.2).alias("normal_width"),
    )


# --- plans ---


@_register("""WITH c(corpus) AS (VALUES ('api_docs'), ('contracts')), k(chunker) AS (VALUES ('fixed'), ('markdown')), e(embedder) AS (VALUES ('a'), ('b'), ('c')), r(retriever) AS (VALUES ('dense'), ('bm25'), ('hybrid'))
SELECT corpus, chunker, embedder, retriever FROM c, k, e, r WHERE NOT (retriever = 'bm25' AND embedder IN ('b', 'c'))""")
def matrix_expansion(spark, folder):
    one = spark.range(1, numPartitions=1)
    column = lambda name, values: one.select(F.explode(F.array(*map(F.lit, values))).alias(name))
    names = ("corpus", "chunker", "embedder", "retriever")
    rule = lambda *values: F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, values)))
    exclude = one.select(F.inline(F.array(rule(None, None, "b", "bm25"), rule(None, None, "c", "bm25"))))
    return matrix.expand_frame(
        column("corpus", ["api_docs", "contracts"]), column("chunker", ["fixed", "markdown"]), column("embedder", "abc"),
        column("retriever", ["dense", "bm25", "hybrid"]), exclude,
    )
