import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions.tokens import PORTABLE, Measured, tokens
from gleanery.operators import ann, chunkers, metrics, relations, retrieval, stats

WORDS = " ".join(f"word{i}" for i in range(200))
TEXTS = {
    "plain": "One short sentence here. " * 40 + "\n\n" + "Another paragraph, with commas. " * 30,
    "fenced": "# Top\n\nIntro text.\n\n## Part\n\n```py\n" + WORDS + "\n```\n\nAfter the fence. " + "More text follows here. " * 60 + "\n\n### Deep\n\nEnd.\n",
    "table": "Before the table.\n\n| a | b |\n| --- | --- |\n" + "| 1 | 2 |\n" * 20 + "\nAfter the table.\n",
    "deep": "## Second level first\n\n" + "text " * 90 + "\n\n## Again second\n\n" + "text " * 90,
    "japanese": "日本語の文章です。改行もあります。\n" * 30,
    "one": "Single sentence",
    "blank": " \n",
    "empty": "",
    "null": None,
    "odd": "a\u0001b \r\n" * 40,
}
ALL = {"fixed": {"chunk_tokens": 40, "overlap_tokens": 8}, "recursive": {"chunk_tokens": 40, "overlap_tokens": 8}, "markdown": {"max_tokens": 60, "min_tokens": 10}, "sentence_window": {}, "semantic": {"min_tokens": 10, "max_tokens": 60}, "table_summary": {"fallback_chunk_tokens": 40}, "paragraph": {}}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, "c", t) for k, t in TEXTS.items()], "doc_id string, corpus string, text string").cache()


@pytest.mark.parametrize("name", list(ALL))
def test_chunks_are_slices_that_cover_the_text(docs, name):
    rows = chunkers.chunk(docs, name, ALL[name]).orderBy("doc_id", "ordinal").collect()
    timed = lambda r: r.asDict() | {"meta": {k: v for k, v in r["meta"].items() if k != "chunk_build_seconds"}}
    assert [timed(r) for r in chunkers.chunk(docs, name, ALL[name]).orderBy("doc_id", "ordinal").collect()] == [timed(r) for r in rows]
    assert all(("chunk_build_seconds" in r["meta"]) == (name == "semantic") for r in rows)
    by_doc = {}
    for r in rows:
        assert r["text"] == TEXTS[r["doc_id"]][r["char_start"] : r["char_end"]]
        assert r["token_count"] == tokens(PORTABLE).count(r["text"])
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert not {"empty", "null"} & set(by_doc)
    for doc, own in by_doc.items():
        assert [r["ordinal"] for r in own] == list(range(len(own)))
        seen = set()
        for r in own:
            seen.update(range(r["char_start"], r["char_end"]))
        solid = [i for i, c in enumerate(TEXTS[doc]) if not c.isspace()]
        assert len(seen.intersection(solid)) >= 0.99 * len(solid)


def test_fixed_in_both_ways(docs):
    for size, overlap in ((40, 8), (7, 0), (16, 12), (1, 0)):
        over = {"chunk_tokens": size, "overlap_tokens": overlap}
        got = {(r["doc_id"], r["ordinal"]): (r["char_start"], r["char_end"]) for r in chunkers.specs(docs, "fixed", over).collect()}
        want = {(k, n): s for k, t in TEXTS.items() if t for n, s in enumerate(tokens(PORTABLE).windows(t, 0, size, overlap))}
        assert got == want
    with pytest.raises(ValueError):
        chunkers.specs(docs, "fixed", {"chunk_tokens": 4, "overlap_tokens": 4})


def test_fence_is_kept_whole(docs):
    start = TEXTS["fenced"].index("```py")
    end = TEXTS["fenced"].index("```", start + 3) + 3
    rows = chunkers.chunk(docs, "markdown", ALL["markdown"]).filter("doc_id = 'fenced'").collect()
    assert sum(r["char_start"] <= start and end <= r["char_end"] for r in rows) == 1
    text = "words " * 20 + "\n\n```\n" + WORDS + "\n```\n\n" + "words " * 20
    a, b = text.index("```"), text.rindex("```") + 3
    spans = chunkers.recursive_spans(Measured(tokens(PORTABLE), text), (0, len(text)), 10, 0, chunkers.SEPARATORS, [(a, b)])
    assert sum(s <= a and b <= e for s, e in spans) == 1 and not any(a < x < b for s in spans for x in s)


def test_fences_are_split_by_windows_but_not_by_structure(docs):
    fences = stats.regions(docs.filter("doc_id = 'fenced'"), "fence")
    fixed = chunkers.chunk(docs.filter("doc_id = 'fenced'"), "fixed", {"chunk_tokens": 128, "overlap_tokens": 0})
    structural = chunkers.chunk(docs.filter("doc_id = 'fenced'"), "markdown", {"max_tokens": 128, "min_tokens": 16})
    assert relations.split_regions(fixed, fences).count() == 1 and relations.split_regions(structural, fences).count() == 0


def test_heading_paths_by_position(docs):
    rows = chunkers.chunk(docs, "markdown", {"max_tokens": 500, "min_tokens": 1}).filter("doc_id = 'deep'").orderBy("ordinal").collect()
    assert [r["heading_path"] for r in rows] == [[], ["Second level first"]]
    assert rows[1]["embed_text"] == "Second level first\n\n" + rows[1]["text"]
    rows = chunkers.chunk(docs, "markdown", {"max_tokens": 5000, "min_tokens": 1}).filter("doc_id = 'fenced'").orderBy("ordinal").collect()
    assert [r["heading_path"] for r in rows] == [[], ["Top"], ["Top", "Part"]]


def test_packing():
    spans = [(i, i + 1) for i in range(6)]
    assert chunkers.packed(spans, [4, 4, 4, 4, 4, 4], 10, 4) == [(0, 2), (1, 3), (2, 4), (3, 5), (4, 6)]
    assert chunkers.packed(spans, [4, 4, 4, 4, 4, 4], 10, 0) == [(0, 2), (2, 4), (4, 6)]
    assert chunkers.packed(spans[:4], [3, 2, 3, 8], 10, 5)[-1] == (3, 4)  # a tail that leaves no room isn't closed for ever
    assert chunkers.packed([], [], 10, 0) == []


def test_windows_and_tables(docs):
    rows = chunkers.chunk(docs, "sentence_window", {"window_size": 1, "stride": 2}).filter("doc_id = 'plain'").orderBy("ordinal").collect()
    assert rows[1]["meta"] == {"center_sentence_index": "2"} and rows[1]["embed_text"] in rows[1]["text"] and rows[1]["text"].count(".") == 3
    tables = chunkers.chunk(docs, "table_summary", {}).filter("meta['is_table'] = 'true'").collect()
    assert [r["doc_id"] for r in tables] == ["table"] and tables[0]["embed_text"].startswith("[mock-llm] ") and tables[0]["embed_text"].endswith(tables[0]["text"])
    with pytest.raises(ValueError):
        chunkers.resolve("none")


def test_topics_are_cut_apart(spark):
    topics = ["The cat sat on a mat with the cat.", "Stocks fell as the bank cut rates today.", "Goals in the late match gave them a win."]
    text = " ".join(s for t in topics for s in [t] * 8)
    doc = spark.createDataFrame([("d", "c", text)], "doc_id string, corpus string, text string")
    rows = chunkers.chunk(doc, "semantic", {"min_tokens": 1, "breakpoint_percentile": 80, "buffer_size": 0}).collect()
    assert len(rows) == 3


# --- joins ---


def gold(spark, spans, chunks):
    pairs = spark.createDataFrame([("q", "d", spans)], "query_id string, gold_doc_id string, gold_char_spans array<array<int>>")
    rows = spark.createDataFrame([("d", f"c{i}", a, b) for i, (a, b) in enumerate(chunks)], "doc_id string, chunk_id string, char_start int, char_end int")
    return sorted((r["span_no"], r["chunk_id"]) for r in relations.resolve_gold(pairs, rows).collect())


def test_gold(spark):
    assert gold(spark, [[400, 420]], [(0, 1000)]) == [(0, "c0")]
    assert gold(spark, [[0, 100]], [(0, 60), (50, 100), (200, 300)]) == [(0, "c0"), (0, "c1")]
    assert gold(spark, [[0, 100]], [(90, 200)]) == []
    assert gold(spark, [[0, 50], [500, 550]], [(200, 300)]) == []
    assert gold(spark, [[5, 5], [7, 9]], [(0, 0), (0, 10)]) == [(1, "c1")]


def test_parents(spark):
    child = spark.createDataFrame([("d", 0, "x", 0, 10, None), ("d", 1, "y", 10, 20, None), ("d", 2, "z", 95, 105, None), ("e", 0, "w", 0, 5, None)], "doc_id string, ordinal int, chunk_id string, char_start int, char_end int, parent_id string")
    parent = spark.createDataFrame([("d", "big", 0, 100), ("d", "small", 0, 20), ("d", "twin", 5, 25)], "doc_id string, chunk_id string, char_start int, char_end int")
    got = {r["chunk_id"]: r["parent_id"] for r in relations.assign_parents(child, parent).collect()}
    assert got == {"x": "small", "y": "small", "z": None, "w": None}
    assert relations.orphans(child, parent).count() == 2
    with pytest.raises(Exception, match="no parent for chunk"):
        relations.require_parents(child, parent).collect()


def test_regions_and_coverage(spark, docs):
    chunks = spark.createDataFrame([("fenced", 0, 40), ("fenced", 40, 3000), ("table", 0, 19)], "doc_id string, char_start int, char_end int")
    assert relations.split_regions(chunks, stats.regions(docs, "fence")).count() == 1
    assert relations.split_regions(chunks, stats.regions(docs, "table")).count() == 0
    spans = spark.createDataFrame([("one", 0, 4), ("one", 2, 6), ("one", 10, 12), ("one", 3, 5)], "doc_id string, char_start int, char_end int")
    got = {r["doc_id"]: tuple(r)[1:] for r in relations.coverage(spans, docs.filter("doc_id in ('one', 'blank')")).collect()}
    # "Single sentence": 6 of its signs and 2 more are covered, the blank at 6 is not
    assert got["one"] == (15, 8, 14, 8, round(8 / 14, 6)) and got["blank"][1] == got["blank"][3] == 0 and got["blank"][4] == 1.0
    assert {tuple(r) for r in relations.covered_spans(spans).collect()} == {("one", 0, 6), ("one", 10, 12)}


def test_needles(spark):
    docs = spark.createDataFrame([("d1", "c", "b.md", "aba xyz"), ("d2", "c", "a.md", "only aba"), ("d3", "o", "a.md", "aba xyz"), ("d4", "c", "c.md", None)], "doc_id string, corpus string, source_path string, text string")
    needles = spark.createDataFrame([("n1", "c", "q", ["xyz", "a"]), ("n2", "c", "q", ["aba"]), ("n3", "c", "q", ["none"]), ("n4", "c", "q", []), ("n5", "c", "q", [None, "", "xyz"])], "needle_id string, corpus string, query string, needles array<string>")
    got = {r["needle_id"]: (r["gold_doc_id"], r["gold_char_spans"]) for r in relations.needle_evalset(docs, needles).collect()}
    assert got == {"n1": ("d1", [[4, 7], [0, 1]]), "n2": ("d2", [[5, 8]]), "n5": ("d1", [[4, 7]])}
    with pytest.raises(Exception, match="a needle repeats"):
        relations.needle_evalset(docs, needles, once=True).collect()


def test_reranking(spark):
    chunks = spark.createDataFrame([("A", "aaa"), ("B", "b"), ("C", "cc")], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "x")], "query_id string, query string")
    found = hits(spark, "d", "BCA")
    assert retrieval.reranked(found, queries, chunks).collect() == found.collect()
    rows = retrieval.reranked(found, queries, chunks, lambda q, t: F.length(t), 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [("A", 3.0), ("C", 2.0)]


# --- retrieval ---


def hits(spark, name, ids):
    return spark.createDataFrame([("q", c, 1.0 / r, r, name) for r, c in enumerate(ids, 1)], "query_id string, chunk_id string, score double, rank int, retriever string")


def test_fusion(spark):
    rows = retrieval.fuse({"dense": hits(spark, "dense", "ABC"), "sparse": hits(spark, "sparse", "AC")}, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["A", "C", "B"]
    assert np.allclose([r["score"] for r in rows], [2 / 61, 1 / 63 + 1 / 62, 1 / 62], atol=1e-9)
    weighted = retrieval.fuse({"dense": hits(spark, "d", "A"), "sparse": hits(spark, "s", "A")}, 1, 60, {"dense": 2.0}).first()
    assert abs(weighted["score"] - 3 / 61) < 1e-9


def test_window_dedup_keeps_half_overlaps(spark):
    chunks = spark.createDataFrame([("A", "d", 0, 10), ("B", "d", 5, 15), ("C", "d", 6, 16), ("D", "e", 0, 10), ("E", "d", 0, 0)], "chunk_id string, doc_id string, char_start int, char_end int")
    rows = retrieval.without_overlaps(hits(spark, "d", "ABCDE"), chunks, 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["A", "B", "D", "E"]  # C shares 9 of 10 with B


def test_parent_hits(spark):
    chunks = spark.createDataFrame([("a", "P"), ("b", "Q"), ("c", "P")], "chunk_id string, parent_id string")
    rows = retrieval.to_parents(hits(spark, "d", "bac"), chunks, 5).orderBy("rank").collect()
    assert [(r["chunk_id"], r["n_children"]) for r in rows] == [("Q", 1), ("P", 2)]
    lone = chunks.withColumn("parent_id", F.when(F.col("chunk_id") != "b", F.col("parent_id")))
    assert [(r["chunk_id"], r["n_children"]) for r in retrieval.to_parents(hits(spark, "d", "bac"), lone, 5).collect()] == [("P", 2)]  # b is passed over
    with pytest.raises(Exception, match="no hit has a parent"):
        retrieval.to_parents(hits(spark, "d", "ab"), chunks.withColumn("parent_id", F.lit(None).cast("string")), 5).collect()
    with pytest.raises(Exception, match="hit of an unknown chunk: z"):
        retrieval.to_parents(hits(spark, "d", "az"), chunks, 5).collect()
    with pytest.raises(Exception, match="parent outside"):
        retrieval.to_parents(hits(spark, "d", "ab"), chunks, 5, parents=spark.createDataFrame([("P",)], "chunk_id string")).collect()


def okapi(texts, query, k1=1.5, b=0.75):
    import re

    terms = [re.findall("[a-z0-9_]+", t.lower()) for t in texts]
    n, mean = len(terms), sum(map(len, terms)) / len(terms)
    df = {t: sum(t in d for d in terms) for d in terms for t in d}
    idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: x if x >= 0 else floor for t, x in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in re.findall("[a-z0-9_]+", query.lower())) for d in terms]


def test_bm25(spark, monkeypatch):
    texts = ["the cat sat", "the dog sat on the mat", "the bird", "", "Cat cat CAT dog"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)] + [("c9", None)], "chunk_id string, text string")
    queries = [("q1", "cat dog cat"), ("q2", "unknown"), ("q3", None), ("q4", "the sat")]
    want = {}
    for q, query in queries:
        scores = [round(s, 6) for s in okapi([*texts, ""], query or "")]
        want[q] = sorted(((-s, f"c{i if i < 5 else 9}") for i, s in enumerate(scores)))[:4]
    for block in (4096, 2):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        rows = retrieval.bm25(spark.createDataFrame(queries, "query_id string, query string"), chunks, 4).orderBy("query_id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r["query_id"], []).append((-r["score"], r["chunk_id"]))
        assert got == want
    index = retrieval.postings(chunks)
    rows = retrieval.bm25_indexed(spark.createDataFrame(queries[:1], "query_id string, query string"), index, retrieval.lengths(chunks.fillna("")), 4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == [c for s, c in want["q1"] if s]
    assert retrieval.bm25(spark.createDataFrame([], "query_id string, query string"), chunks, 4).count() == 0
    assert retrieval.bm25(spark.createDataFrame(queries, "query_id string, query string"), chunks.limit(0), 4).count() == 0


def test_dense(spark):
    rng = np.random.default_rng(1)
    store = rng.normal(size=(90, 8))
    store[7] = store[3]
    frame = spark.createDataFrame([(f"c{i:02}", v.tolist()) for i, v in enumerate(store)] + [("zero", [0.0] * 8), ("none", None)], "chunk_id string, embedding array<double>")
    asked = [(f"q{i}", store[i].tolist()) for i in range(5)] + [("qn", None)]
    for block in (4096, 2):
        rows = retrieval.dense(spark.createDataFrame(asked, "query_id string, vector array<double>"), frame.repartition(7), 6, block=block).orderBy("query_id", "rank").collect()
        for i in range(5):
            scores = np.round(store @ store[i] / np.linalg.norm(store, axis=1) / np.linalg.norm(store[i]), 6)
            want = sorted((-s, f"c{n:02}") for n, s in enumerate(scores))[:6]
            assert [r["chunk_id"] for r in rows if r["query_id"] == f"q{i}"] == [c for _, c in want]
    assert len(rows) == 30


# --- metrics ---


def score(spark, retrieved, gold_ids, k=10, spans=1, sizes=None):
    pairs = spark.createDataFrame([("q", "text", [[0, 1]] * spans)], "query_id string, query string, gold_char_spans array<array<int>>")
    found = hits(spark, "d", retrieved) if retrieved else hits(spark, "d", "x").limit(0)
    wanted = spark.createDataFrame([("q", n, c) for n, group in enumerate(gold_ids) for c in group], "query_id string, span_no int, chunk_id string")
    chunks = spark.createDataFrame([(c, (sizes or {}).get(c, 1)) for c in set("".join(retrieved) + "z")], "chunk_id string, token_count int")
    return metrics.traces(pairs, found, wanted, chunks, k).first()


def test_metrics_by_hand(spark):
    row = score(spark, "ABCD", ["BD"], 4)
    assert abs(row["ndcg_10"] - (1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))) < 1e-12
    assert row["first_hit_rank"] == 2 and row["recall_1"] == 0.0 and row["recall_3"] == 1.0 and "recall_5" not in row
    assert score(spark, "a", ["abc"], 1)["ndcg_10"] == 1.0
    assert abs(score(spark, "abc", ["c"])["mrr"] - 1 / 3) < 1e-12
    assert score(spark, "abc", ["a"], 2, sizes={"a": 5, "b": 10, "c": 90})["chunk_efficiency"] == 15.0
    assert score(spark, "abc", ["c"], 2, sizes={"a": 5})["chunk_efficiency"] is None
    assert score(spark, "ab", ["a", "b"], 2, 2)["all_spans_hit"] == 1.0 and score(spark, "ab", ["a", "c"], 2, 2)["all_spans_hit"] == 0.0
    assert score(spark, "ab", ["a"], 2, 2)["all_spans_hit"] == 0.0 and score(spark, "ab", ["a"], 2)["all_spans_hit"] is None
    out = score(spark, "ab", [])
    assert out["excluded"] and out["mrr"] is None and out["exclusion_reason"]
    assert score(spark, "", ["a"])["mrr"] == 0.0


def test_bootstrap(spark, monkeypatch):
    assert metrics.bootstrap_interval(np.array([])) == (0.0, 0.0) and metrics.bootstrap_interval(np.array([0.5])) == (0.5, 0.5)
    values = np.random.default_rng(5).random(500)
    whole = metrics.bootstrap_interval(values)
    monkeypatch.setattr(metrics, "DRAWN", 1700)  # three resamples at a time
    assert metrics.bootstrap_interval(values) == whole
    low, high = metrics.bootstrap_interval(np.r_[np.zeros(50), np.ones(50)])
    assert 0.35 < low < 0.5 < high < 0.65
    rows = spark.createDataFrame([("a", f"q{i:02}", float(i % 2)) for i in range(40)] + [("b", "q", None)], "cell string, query_id string, v double")
    got = {r["cell"]: r for r in metrics.bootstrap(rows, ["cell"], "v", "query_id").collect()}
    assert (got["a"]["low"], got["a"]["high"]) == metrics.bootstrap_interval(np.tile([0.0, 1.0], 20)) and got["b"]["n"] == 0


def test_stats(spark, docs):
    row = stats.corpus_stats(docs.filter("text is not null")).first()
    assert row["docs"] == 9 and row["tables"] == 1 and row["code_blocks"] == 1 and row["min_tokens"] == 0
    assert stats.corpus_stats(docs.limit(0)).count() == 0
    mix = stats.language_map(docs.filter("text is not null")).first()["lang_mix"]
    assert mix["ja"] == 1 and mix["en"] == 8
    sizes = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 10)], "token_count int").agg(*stats.percentiles("token_count")).first()
    assert sizes["p95_tokens"] == pytest.approx(8.8)
    chunks = chunkers.chunk(docs, "fixed", {"chunk_tokens": 40, "overlap_tokens": 8})
    got = stats.chunk_stats(chunks, docs).first()
    assert got["fences"] == got["split_fences"] == 1 and got["tables"] == 1 and 0 < got["split_sentence_rate"] <= 1 and got["docs"] == 7


def test_best_columns_with_ties():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        scores, k = rnd.integers(0, 4, (7, int(rnd.integers(1, 30)))).astype(float), int(rnd.integers(1, 9))
        ids = np.array([f"{i:02}" for i in rnd.permutation(scores.shape[1])], object)
        want = [(q, i, s) for q in range(7) for s, i in [(-x, i) for x, i in sorted(zip(-scores[q], ids))[:k]]]
        order = np.argsort(ids)
        assert list(retrieval._block_best(scores[:, order], ids[order], k).itertuples(index=False, name=None)) == want
        best = retrieval.Best(k)
        for part in np.array_split(np.arange(len(ids)), 6):  # ids are in order within each part only
            if len(part):
                part = part[np.argsort(ids[part])]
                best.add(scores[:, part], ids[part])
        assert list(best.rows().itertuples(index=False, name=None)) == want


def test_sentence_cuts_are_joined_by_equal_places(spark):
    docs = spark.createDataFrame([("d", "One two. Three four. Five."), ("n", None)], "doc_id string, text string")
    rows = [("d", 0, 9), ("d", 9, 14), ("d", 4, 26), ("d", 21, 99), ("x", 1, 2), ("n", 1, 2)]
    got = stats.cut_sentences(spark.createDataFrame(rows, "doc_id string, char_start int, char_end int"), docs)
    assert {tuple(r) for r in got.collect()} == {("d", 0, 9, False), ("d", 9, 14, True), ("d", 4, 26, True), ("d", 21, 99, False), ("x", 1, 2, False), ("n", 1, 2, False)}


def test_inverted_lists(spark):
    rnd = np.random.default_rng(8)
    middles = rnd.normal(size=(12, 16))
    rows = [(i, [float(x) for x in middles[i % 12] + 0.3 * rnd.normal(size=16)]) for i in range(900)] + [(900, [0.0] * 16), (901, None)]
    store = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = store.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = retrieval.dense(asked, store, 10)
    centers = ann.fit_centroids(store, 12, sample_rows=300)
    index = ann.filed(store, centers)
    assert index.count() == 901 and centers.shape == (12, 16)  # every row that has a vector
    whole = ann.search(asked, index, centers, 10, 12)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in exact.collect()}
    few = ann.recall(ann.search(asked, index, centers, 10, 3), exact).first()
    assert few["queries"] == 46 and few["recall"] >= 0.9
    none = store.limit(0)
    assert ann.search(asked, ann.filed(none, centers), ann.fit_centroids(none, 4), 10, 3).count() == 0
