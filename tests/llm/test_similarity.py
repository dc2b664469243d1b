import collections
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import components, cross_split, near_duplicates, similarity
from gleanery.llm.similarity import Measure

from .test_textcodes import plain_words

DOC = "doc_id string, text string"
CHUNK = "chunk_id string, doc_id string, text string"


def brute(records, measure):
    """records: {id: text}; all pairs of similar records."""
    sets = {}
    for key, text in records.items():
        w = plain_words(text)
        if len(w) >= measure.min_words:
            sets[key] = {tuple(w[i : i + measure.run_length]) for i in range(len(w) - measure.run_length + 1)}
    out = set()
    for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2):
        x, y = sets[a], sets[b]
        if len(x & y) >= measure.threshold * len(x | y) - 1e-9:
            out.add((a, b))
    return out


def noisy_texts(seed, n, vocabulary, length):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randint(0, 2)] = [f"w{rnd.randrange(vocabulary)}"]
        else:
            words = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(8, length))]
        texts.append(" ".join(words))
    return texts


def test_pairs_equal_brute_force(spark):
    texts = noisy_texts(1, 160, 60, 60)
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], DOC)
    chunks = spark.createDataFrame([], CHUNK)
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.duplicate_pairs(docs, chunks).collect()}
    assert got == brute({f"d{i:03}": t for i, t in enumerate(texts)}, near_duplicates.PROJECT_MEASURE)
    assert len(got) > 30


def test_long_lists_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    stem = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = {f"d{i:02}": f"{stem} tail{i % 7}" for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), DOC)
    got = [(r["id_a"], r["id_b"]) for r in near_duplicates.duplicate_pairs(docs, spark.createDataFrame([], CHUNK)).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2


def test_a_third_of_all_records_are_copies(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    copy = " ".join(f"stock{i}" for i in range(30))
    texts = noisy_texts(11, 120, 500, 40)
    rows = [(f"d{i:03}", t) for i, t in enumerate(texts)] + [(f"s{i:03}", copy) for i in range(60)] + [("near", copy.replace("stock3 ", "other "))]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    chunks = spark.createDataFrame([], CHUNK)
    groups = {r["record_id"]: r for r in near_duplicates.duplicate_groups(docs, chunks).collect()}
    assert len({groups[f"s{i:03}"]["class_id"] for i in range(60)}) == 1 and groups["near"]["n_links"] == 1
    assert groups["near"]["group_id"] == groups["s000"]["group_id"]
    pairs = near_duplicates.duplicate_pairs(docs, chunks)
    assert pairs.filter("id_a like 's%' and id_b like 's%'").count() == 60 * 59 // 2
    assert {tuple(r)[1:] for r in pairs.collect()} == brute(dict(rows), near_duplicates.PROJECT_MEASURE)


def posted(records, bits=None):
    """The inverted-list rows of records, and their classes."""
    measure = near_duplicates.PROJECT_MEASURE
    records = records.select("part", "record", "owner", "role", "text").filter("text is not null").withColumn("th", F.xxhash64("text"))
    classes = similarity._classes(records, similarity._members(records, measure))
    bits = bits or similarity._slot_bits(classes)
    order = similarity._order(classes, similarity._summaries(classes, measure, bits), measure, bits)
    return similarity._postings(classes, order, measure), classes


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_copies_are_listed_once_however_they_are_spread(spark, parts):
    copy = " ".join(f"stock{i}" for i in range(30))
    docs = spark.createDataFrame([(f"s{i:03}", copy) for i in range(640)], DOC).repartition(parts)
    rows, classes = posted(near_duplicates.records_of(docs, spark.createDataFrame([], CHUNK)))
    assert classes.count() == 1
    assert rows.count() == rows.select("key").distinct().count() == len(range(28)) - 16 + 3  # 28 runs, of which 28 - ceil(0.55 * 28) + 3 are kept


def test_a_crowded_count_table_copies_no_row(spark, monkeypatch):
    """Few slots stand for much data: every slot counts far more values than a block has rows."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    texts = noisy_texts(21, 400, 300, 60)
    docs = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], DOC)
    records = near_duplicates.records_of(docs, spark.createDataFrame([], CHUNK))
    assert posted(records, 6)[0].count() == posted(records, 22)[0].count()
    want = brute({f"d{i:03}": t for i, t in enumerate(texts)}, near_duplicates.PROJECT_MEASURE)
    for bits in ((2, 2), (22, 22)):
        monkeypatch.setattr(similarity, "SLOT_BITS", bits)
        assert {tuple(r)[1:] for r in near_duplicates.duplicate_pairs(docs, spark.createDataFrame([], CHUNK)).collect()} == want


def test_stock_phrases_leave_the_lists_of_a_crowded_table(spark, monkeypatch):
    """A quarter of each text is one of two stock phrases; few slots can't tell their runs from rare ones."""
    rnd = random.Random(4)
    stock = [" ".join(f"s{k}x{i}" for i in range(15)) for k in range(2)]
    rows = [(f"d{i:03}", " ".join(f"w{rnd.randrange(10**6)}" for _ in range(45)) + " " + stock[i % 2]) for i in range(300)]
    rows += [("near", rows[7][1].replace(" s1x7", ""))]
    records = near_duplicates.records_of(spark.createDataFrame(rows, DOC), spark.createDataFrame([], CHUNK))
    lengths = lambda: posted(records, 4)[0].groupBy("key").count()
    monkeypatch.setattr(similarity, "CROWDED", 10**6)  # no list is counted
    assert lengths().filter("count > 128").count() > 4
    monkeypatch.setattr(similarity, "CROWDED", 1)
    monkeypatch.setattr(similarity, "LONG_LIST", 8)
    assert lengths().filter("count > 8").count() == 0
    monkeypatch.setattr(similarity, "SLOT_BITS", (4, 4))
    pairs = near_duplicates.duplicate_pairs(spark.createDataFrame(rows, DOC), spark.createDataFrame([], CHUNK))
    assert {tuple(r)[1:] for r in pairs.collect()} == brute(dict(rows), near_duplicates.PROJECT_MEASURE) == {("d007", "near")}
    monkeypatch.setattr(similarity, "STOCK_VALUES", 5)  # not all may be told apart
    assert {tuple(r)[1:] for r in near_duplicates.duplicate_pairs(spark.createDataFrame(rows, DOC), spark.createDataFrame([], CHUNK)).collect()} == {("d007", "near")}


def test_long_lists_copy_late_rows_only_to_early_ones(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    late = 1 << similarity._LATE
    rows = [(1, c, 9, 1, 3) for c in range(10)] + [(1, 100 + c, 9, 1, 3 | late) for c in range(30)] + [(2, c, 9, 1, 3 | late) for c in range(50)]
    long = spark.createDataFrame(rows, "key long, a long, x int, y int, tag long")
    got = similarity._split_lists(long).collect()
    # 3 blocks of early and 8 of late rows: an early row goes to 3 + 8 groups, a late one to 3; a list of late rows alone to none
    assert len(got) == 10 * 11 + 30 * 3
    met = set()
    groups = {}
    for r in got:
        groups.setdefault(r["key"], []).append(r)
    for members in groups.values():
        for x, y in itertools.combinations(members, 2):
            blocks = [(r["tag"] >> 2) & ((1 << 38) - 1) for r in (x, y)]
            if not (x["tag"] >> similarity._OTHER & 1) or blocks[0] != blocks[1]:
                pair = tuple(sorted((x["cls"], y["cls"])))
                if min(pair) < 100:
                    assert pair not in met
                    met.add(pair)
    assert len(met) == 45 + 300


def test_a_worker_holds_few_pairs_of_dense_lists(monkeypatch):
    """All classes of a list are similar, so its pairs are the square of its rows; two of the lists have the same classes."""
    cls = np.r_[np.arange(400), np.arange(400), np.arange(1000, 1800)]
    block = np.stack([np.repeat(np.arange(4), 400), cls, *(np.full(1600, v) for v in (100, 1, 3))])
    monkeypatch.setattr(similarity, "PAIRS_HELD", 20_000, raising=False)
    monkeypatch.setattr(similarity, "PAIRS_SENT", 1_000, raising=False)
    lists = lambda: similarity._list_pairs(block, near_duplicates.PROJECT_MEASURE)
    next(lists())  # what is imported late doesn't count
    tracemalloc.start()
    largest = max(batch.num_rows for batch in lists())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert largest == 1_000 and peak < 8_000_000  # 319,200 pairs
    shared = collections.Counter()
    for batch in lists():
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
            assert y == 3
            shared[a, b] += x
    want = {(a, b): 2 for a, b in itertools.combinations(range(400), 2)}
    want |= {(a, b): 1 for k in (1000, 1400) for a, b in itertools.combinations(range(k, k + 400), 2)}
    assert shared == want


def test_groups_and_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(4000))
    near = long.replace("v17 ", "changed ")
    docs = spark.createDataFrame([("a", long), ("a", long), ("b", near), ("c", None), ("d", ""), ("e", "too short"), (None, long)], DOC)
    chunks = spark.createDataFrame([("x", "a", long), ("y", "a", near), ("z", None, long), ("x", "a", long)], CHUNK)
    pairs = {tuple(r) for r in near_duplicates.duplicate_pairs(docs, chunks).collect()}
    # x and y are of one document; a null document differs from every other
    assert pairs == {("doc", "a", "b"), ("child", "x", "z"), ("child", "y", "z")}
    groups = near_duplicates.duplicate_groups(docs, chunks).collect()
    assert sorted(r["record_id"] for r in groups) == ["a", "b", "x", "y", "z"]
    assert len({r["group_id"] for r in groups}) == 2 and all(r["n_links"] == 1 for r in groups)
    empty = spark.createDataFrame([], DOC)
    assert near_duplicates.duplicate_pairs(empty, spark.createDataFrame([], CHUNK)).count() == 0
    assert near_duplicates.duplicate_groups(empty, spark.createDataFrame([], CHUNK)).count() == 0


def test_default_measure_is_five_words_and_four_fifths():
    assert Measure() == Measure(5, 0.8, 1, False, 3)
    assert Measure(miss=0).least_sketch_hits() == 0 < Measure().least_sketch_hits()


@pytest.fixture()
def evalset(spark):
    rows = [
        ("q1", "c", "What is the refund limit?", "train"), ("q2", "c", "what IS the—refund limit", "Test "), ("q3", "c", "What is the refund limit today?", "validation"),
        ("q4", "c", "Entirely other words here", "dev"), ("q5", "c", None, "dev"), ("q6", "c", "refund limit", None), ("q7", "c", "?!", "test"), (None, "c", "What is the refund limit?", "dev"),
        ("q1", "c", "What is the refund limit?", "train"), ("q8", "c", "the refund limit, what is", "trn"), ("q9", "c", "what is the refund limit?", "unknown"),
    ]
    return spark.createDataFrame(rows, "query_id string, corpus string, query string, split string")


def test_cross_split_pairs_and_report(spark, evalset):
    got = {tuple(r) for r in cross_split.overlapping_questions(evalset).collect()}
    assert got == {("q1", "q2"), ("q1", "q3"), ("q2", "q8"), ("q3", "q8")}
    report = {(r["split"], r["corpus"]): (r["n_questions"], r["n_exact"], r["n_leaked"]) for r in cross_split.overlap_report(evalset).collect()}
    assert report == {("test", "c"): (2, 1, 1), ("dev", "c"): (3, 0, 1)}
    assert cross_split.overlapping_questions(evalset.limit(0)).count() == 0


def test_cross_split_equals_brute_force(spark):
    texts = noisy_texts(5, 200, 30, 14)
    rows = [(f"q{i:03}", "c", t, "train" if i % 2 else "dev") for i, t in enumerate(texts)]
    got = {tuple(r) for r in cross_split.overlapping_questions(spark.createDataFrame(rows, "query_id string, corpus string, query string, split string")).collect()}
    want = set()
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = set(plain_words(texts[a])), set(plain_words(texts[b]))
        if (a + b) % 2 and len(x & y) >= 0.6 * len(x | y) - 1e-9:
            want.add((f"q{a:03}", f"q{b:03}"))
    assert got == want and len(want) > 50


def test_components_of_paths_stars_and_loops(spark):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(30)] + [("x", "x"), ("y", "z"), ("z", "y"), ("y", "z"), (None, "y"), ("k", None)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"p{i:03}"] for i in range(61)} == {"p000"}
    assert {got[f"s{i}"] for i in range(30)} | {got["hub"]} == {"hub"}
    assert got["x"] == "x" and got["y"] == got["z"] == "y" and "k" not in got and len(got) == 61 + 31 + 3
    assert components.connected_components(spark.createDataFrame([], "u string, v string")).count() == 0
