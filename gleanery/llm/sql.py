"""SQL for the pN_ queries that SQL can express at test size, for a side-by-side check."""

from __future__ import annotations

import sys
import unicodedata

from gleanery.llm import labels

_BARE = "nullif(right(regexp_replace(lower({}), '[^0-9a-f]', '', 'g'), 12), '')"
_BLANK = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _tidy(value: str) -> str:
    return f"lower(regexp_replace({value}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'))"


def _looked_up(table: dict[str, str], value: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_SPLIT = _looked_up(labels.SPLITS, _tidy("split"))
_CODE = "regexp_extract(" + _tidy("lang") + ", '^([^-_]*)', 1)"
_LANGUAGE = f"coalesce({_looked_up(labels.LANGUAGES, _CODE)}, 'und')"
_DOMAIN = f"CASE WHEN domain IS NULL OR {_tidy('domain')} = '' THEN 'unknown' ELSE {_tidy('domain')} END"
_KANA = "\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}\\x{30FC}\\x{4E00}-\\x{9FFF}"
# letters and digits without kana and kanji: RE2 has no class difference, so kana and kanji are first turned into blanks
_NARROW = f"regexp_replace(@, '[{_KANA}]', ' ', 'g')"


def _inside_word(p: str) -> str:
    left = f"regexp_extract({_NARROW.replace('@', f'substring(whole, greatest({p} - most, 0) + 1, least({p}, most))')}, '[\\p{{L}}\\p{{N}}]*$')"
    right = f"regexp_extract({_NARROW.replace('@', f'substring(whole, {p} + 1, most)')}, '^[\\p{{L}}\\p{{N}}]*')"
    return f"({p} > 0 AND {p} < length(whole) AND length({left}) > 0 AND length({right}) > 0 AND length({left}) + length({right}) <= most)"


def _inside_fence(p: str) -> str:
    return f"({p} > 0 AND {p} < length(whole) AND len(list_filter(fences, lambda f: f.s < {p} AND {p} < f.e AND f.e - f.s <= most)) > 0)"


_P3 = f"""WITH RECURSIVE edges AS (SELECT {_BARE.format('old_doc_id')} AS u, {_BARE.format('new_doc_id')} AS v FROM doc_moves),
arcs AS (SELECT u, v FROM edges WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM edges WHERE u IS NOT NULL AND v IS NOT NULL),
reach(node, root) AS (SELECT u, u FROM arcs UNION SELECT a.v, r.root FROM reach r JOIN arcs a ON a.u = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
rec AS (SELECT query_id, {_BARE.format('gold_doc_id')} AS bare, {_SPLIT} AS split FROM evalset),
grp AS (SELECT query_id, coalesce(component, bare) AS g, split FROM rec LEFT JOIN comp ON comp.node = rec.bare WHERE bare IS NOT NULL AND split IS NOT NULL)
SELECT DISTINCT query_id FROM grp WHERE query_id IS NOT NULL AND g IN (SELECT g FROM grp GROUP BY g HAVING count(DISTINCT split) > 1)"""

_P4 = f"""WITH c AS (SELECT DISTINCT chunk_id, doc_id, chunk_set_id, ordinal, char_start AS s, char_end AS e, chunker_params['max_chars']::INT AS most, chunker_params['overlap_chars']::INT AS shared, text FROM chunks_child),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, chunk_set_id ORDER BY ordinal, chunk_id), 0) AS prev FROM c),
lines AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM corpus_docs)),
placed AS (SELECT doc_id, n, ls[n] AS line, sum(length(ls[n]) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(ls[n]) - 1 AS a FROM lines),
marks AS (SELECT doc_id, a, a + length(line) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM placed WHERE starts_with(line, '```')),
f AS (SELECT o.doc_id, list({{'s': o.a, 'e': k.b}}) AS fences FROM marks o JOIN marks k ON k.doc_id = o.doc_id AND k.r = o.r + 1 WHERE o.r % 2 = 1 GROUP BY o.doc_id),
j AS (SELECT p.*, d.text AS whole, coalesce(f.fences, []) AS fences FROM p JOIN (SELECT DISTINCT doc_id, text FROM corpus_docs) d USING (doc_id) LEFT JOIN f USING (doc_id))
SELECT DISTINCT chunk_id FROM j WHERE e - s > most OR substring(whole, s + 1, e - s) <> text OR {_inside_word('s')} OR {_inside_word('e')} OR {_inside_fence('s')} OR {_inside_fence('e')}
 OR (s > prev AND regexp_matches(substring(whole, prev + 1, s - prev), '\\S')) OR prev - s > shared"""

_WINDOWS = """w AS (SELECT doc_id, i, md5(substring(text, i, 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), sw AS (SELECT w.* FROM w SEMI JOIN s ON s.h = w.h)"""
_P8 = f"WITH {_WINDOWS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM sw a JOIN sw b ON a.h = b.h AND a.doc_id < b.doc_id"
_P8_COVERAGE = f"""WITH {_WINDOWS}, r AS (SELECT doc_id, i - 1 AS a, i + 319 AS b, max(i + 319) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sw),
t AS (SELECT doc_id, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) AS n_spans, sum(b - greatest(a, coalesce(reach, a))) AS shared_chars FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(d.text), 0)::INT AS n_chars, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
 CASE WHEN length(d.text) > 0 THEN round(coalesce(shared_chars, 0)::DOUBLE / length(d.text), 6) ELSE 0.0 END AS shared_fraction FROM documents d LEFT JOIN t USING (doc_id)"""




def _fold_rows() -> str:
    """(sign, folded) for each sign that NFKD, dropping nonspacing marks and lower case change; Hangul syllables stay, which tells no words apart or together."""
    rows = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        sign = chr(code)
        to = "".join(c for c in unicodedata.normalize("NFKD", sign).lower() if unicodedata.category(c) != "Mn")
        if to != sign:
            rows.append(f"('{sign}','{to.replace(chr(39), chr(39) * 2)}')")
    return ",".join(rows)


def _words(source: str) -> str:
    """Common table expressions `words` (text, w): the words of each distinct text of a query that gives `text`."""
    return f"""fold(c, t) AS (VALUES {_fold_rows()}),
texts AS (SELECT DISTINCT text FROM ({source}) WHERE text IS NOT NULL),
signs AS (SELECT text, unnest(regexp_extract_all(text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) AS i FROM texts WHERE regexp_matches(text, '[^\\x00-\\x7F]')),
folded AS (SELECT text, string_agg(coalesce(t, c), '' ORDER BY i) AS f FROM signs LEFT JOIN fold USING (c) GROUP BY text UNION ALL SELECT text, text FROM texts WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')),
words AS (SELECT text, regexp_extract_all(regexp_replace(lower(f), '([{_KANA}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS w FROM folded)"""


# --- 1 ---

_P1_RECORDS = f"""WITH d AS (SELECT doc_id, any_value(corpus) AS corpus, max({_LANGUAGE}) AS language, max({_DOMAIN}) AS domain FROM (SELECT doc_id, corpus, meta['lang'] AS lang, meta['domain'] AS domain FROM corpus_docs WHERE doc_id IS NOT NULL) GROUP BY doc_id),
c AS (SELECT chunk_id, any_value(doc_id) AS doc_id, any_value(corpus) AS corpus FROM chunks_child WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
r AS (SELECT 'doc' AS record_kind, corpus, language, domain FROM d UNION ALL SELECT 'child', c.corpus, coalesce(d.language, 'und'), coalesce(d.domain, 'unknown') FROM c LEFT JOIN d USING (doc_id))
SELECT record_kind, corpus, language, domain, count(*) AS n_records FROM r GROUP BY ALL"""

# --- 2 ---

_P2_SETS = f"""{_words("SELECT text FROM chunks_child UNION ALL SELECT text FROM corpus_docs")},
runs AS (SELECT text, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS r FROM words WHERE len(w) >= 10),
recs AS (SELECT DISTINCT 'child' AS kind, chunk_id AS id, doc_id AS owner, text FROM chunks_child WHERE chunk_id IS NOT NULL UNION SELECT DISTINCT 'doc', doc_id, doc_id, text FROM corpus_docs WHERE doc_id IS NOT NULL),
mem AS (SELECT kind, id, owner, md5(array_to_string(list_sort(r), '|')) AS cls, r FROM recs JOIN runs USING (text)),
sets AS (SELECT kind, cls, any_value(r) AS r, len(any_value(r)) AS n, min(id) AS name FROM mem GROUP BY kind, cls),
vals AS (SELECT kind, cls, n, unnest(r) AS v FROM sets),
pairs AS (SELECT a.kind, a.cls AS x, b.cls AS y FROM vals a JOIN vals b ON a.kind = b.kind AND a.v = b.v AND a.cls < b.cls GROUP BY a.kind, a.cls, b.cls, a.n, b.n HAVING count(*) >= 0.55::DOUBLE * (a.n + b.n - count(*)) - 1e-9)"""
_P2_FOUND = f"""WITH {_P2_SETS}, links AS (SELECT kind, x, y FROM pairs UNION ALL SELECT kind, y, x FROM pairs UNION ALL SELECT kind, cls, cls FROM sets)
SELECT DISTINCT a.kind AS record_kind, a.id AS id_a, b.id AS id_b FROM mem a JOIN links l ON l.kind = a.kind AND l.x = a.cls JOIN mem b ON b.kind = a.kind AND b.cls = l.y WHERE a.id < b.id AND a.owner IS DISTINCT FROM b.owner"""
_P2_GROUPS = f"""WITH RECURSIVE {_P2_SETS}, arcs AS (SELECT kind, x, y FROM pairs UNION ALL SELECT kind, y, x FROM pairs),
reach(kind, node, root) AS (SELECT kind, cls, cls FROM sets UNION SELECT r.kind, a.y, r.root FROM reach r JOIN arcs a ON a.kind = r.kind AND a.x = r.node),
grp AS (SELECT r.kind, r.node, min(s.name) AS group_id FROM reach r JOIN sets s ON s.kind = r.kind AND s.cls = r.root GROUP BY r.kind, r.node),
deg AS (SELECT kind, x AS cls, count(*) AS n_links FROM arcs GROUP BY ALL)
SELECT DISTINCT m.kind AS record_kind, m.id AS record_id, s.name AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, g.group_id FROM mem m JOIN sets s USING (kind, cls) JOIN grp g ON g.kind = m.kind AND g.node = m.cls LEFT JOIN deg ON deg.kind = m.kind AND deg.cls = m.cls"""

# --- 3 ---

_P3_SPLITS = f"""WITH RECURSIVE edges AS (SELECT {_BARE.format('old_doc_id')} AS u, {_BARE.format('new_doc_id')} AS v FROM doc_moves),
arcs AS (SELECT u, v FROM edges WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM edges WHERE u IS NOT NULL AND v IS NOT NULL),
reach(node, root) AS (SELECT u, u FROM arcs UNION SELECT a.v, r.root FROM reach r JOIN arcs a ON a.u = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
rec AS (SELECT DISTINCT query_id, coalesce({_BARE.format('gold_doc_id')}, 'query:' || query_id) AS bare FROM evalset WHERE query_id IS NOT NULL),
grp AS (SELECT query_id, coalesce(component, bare) AS g FROM rec LEFT JOIN comp ON comp.node = rec.bare),
sizes AS (SELECT g, count(*) AS n, ('0x' || substring(md5(g), 1, 10))::BIGINT AS place FROM grp GROUP BY g),
total AS (SELECT sum(n)::DOUBLE AS n FROM sizes),
heavy AS (SELECT g, s.n, row_number() OVER (ORDER BY s.n DESC, place, g) AS i FROM sizes s, total t WHERE s.n > 0.01::DOUBLE * t.n),
room(i, g, choice, a, b, c) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0.6::DOUBLE * n, 0.2::DOUBLE * n, 0.2::DOUBLE * n FROM total
 UNION ALL SELECT h.i, h.g, w, CASE WHEN w = 'train' THEN a - n ELSE a END, CASE WHEN w = 'dev' THEN b - n ELSE b END, CASE WHEN w = 'test' THEN c - n ELSE c END
 FROM (SELECT r.*, h.g AS hg, CASE WHEN a >= b AND a >= c AND a > c OR (a >= b AND a = c) THEN 'train' WHEN c >= b THEN 'test' ELSE 'dev' END AS w FROM room r JOIN heavy h ON h.i = r.i + 1) r JOIN heavy h ON h.i = r.i + 1),
rooms AS (SELECT greatest(a, 0) AS a, greatest(b, 0) AS b, greatest(c, 0) AS c FROM room ORDER BY i DESC LIMIT 1),
rest AS (SELECT g, n, sum(n) OVER (ORDER BY place, g) - n / 2 AS middle FROM sizes WHERE g NOT IN (SELECT g FROM heavy)),
cuts AS (SELECT a * k AS one, a * k + b * k AS two FROM rooms, (SELECT coalesce(sum(n), 0)::DOUBLE / CASE WHEN a + b + c > 0 THEN a + b + c ELSE 1 END AS k FROM rest, rooms GROUP BY a, b, c)),
chosen AS (SELECT g, choice AS split FROM room WHERE i > 0 UNION ALL SELECT g, CASE WHEN middle < one THEN 'train' WHEN middle < two THEN 'dev' ELSE 'test' END FROM rest, cuts)
SELECT query_id, g AS group_id, split FROM grp JOIN chosen USING (g)"""

# --- 4 ---

_P4_CHECKS = """SELECT DISTINCT doc_id, chunk_set_id, length(text)::INT AS n_chars, 0::INT AS first_start, length(text)::INT AS last_end, 0::BIGINT AS faults
FROM corpus_docs JOIN (SELECT doc_id, chunk_set_id, max(chunker_params['max_chars']::INT) AS most FROM chunks_child GROUP BY doc_id, chunk_set_id) USING (doc_id) WHERE length(text) > most"""

# --- 5 ---

_P5_SETS = f"""{_words("SELECT query AS text FROM evalset")},
q AS (SELECT DISTINCT query_id, split, w FROM (SELECT query_id, {_SPLIT} AS split, query AS text FROM evalset WHERE query_id IS NOT NULL) JOIN (SELECT text, list_sort(list_distinct(w)) AS w FROM words WHERE len(w) > 0) USING (text) WHERE split IS NOT NULL),
v AS (SELECT query_id, split, w, unnest(w) AS v FROM q),
hits AS (SELECT a.query_id AS asked, a.split, b.query_id AS known, a.w = b.w AS same FROM v a JOIN v b ON a.v = b.v WHERE a.split <> 'train' AND b.split = 'train' AND a.query_id <> b.query_id
 GROUP BY a.query_id, a.split, b.query_id, a.w, b.w HAVING count(*) >= 0.6::DOUBLE * (len(a.w) + len(b.w) - count(*)) - 1e-9)"""
_P5_FOUND = f"WITH {_P5_SETS} SELECT DISTINCT least(asked, known) AS query_id_a, greatest(asked, known) AS query_id_b FROM hits"
_P5_REPORT = f"""WITH {_P5_SETS}, e AS (SELECT DISTINCT query_id, {_SPLIT} AS split, corpus FROM evalset WHERE query_id IS NOT NULL AND {_SPLIT} IN ('dev', 'test'))
SELECT e.split, corpus, count(*) AS n_questions, sum(coalesce(h.same, 0))::BIGINT AS n_exact, count(h.asked) AS n_leaked
FROM e LEFT JOIN (SELECT asked, max(same::INT) AS same FROM hits GROUP BY asked) h ON h.asked = e.query_id GROUP BY ALL"""

# --- 6 ---

_P6_ROUNDTRIP = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"

# --- 7 ---

_P7_FOUND = f"""WITH {_words("SELECT text FROM documents UNION ALL SELECT text FROM heldout_items")},
runs AS (SELECT text, unnest(list_distinct(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')))) AS r FROM words WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM (SELECT item_id, r FROM heldout_items JOIN runs USING (text) WHERE item_id IS NOT NULL) JOIN (SELECT doc_id, r FROM documents JOIN runs USING (text)) USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_records": _P1_RECORDS, "p2_found": _P2_FOUND, "p2_groups": _P2_GROUPS, "p3_found": _P3, "p3_splits": _P3_SPLITS, "p4_found": _P4, "p4_piece_checks": _P4_CHECKS,
        "p5_found": _P5_FOUND, "p5_report": _P5_REPORT, "p6_roundtrip": _P6_ROUNDTRIP, "p7_found": _P7_FOUND, "p8_found": _P8, "p8_coverage": _P8_COVERAGE,
    }
