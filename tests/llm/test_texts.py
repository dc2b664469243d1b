"""Cuts, leaks, shared spans and token budgets against plain versions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.llm import boundary_split, encode, leakage, shared_spans, textcodes, token_budget

from .test_textcodes import plain_words

KANA = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in textcodes.SINGLE_RANGES) + "]")


# --- shared spans ---


def shared(texts, length):
    places = {}
    for key, text in texts.items():
        for i in range(len(text) - length + 1):
            places.setdefault(text[i : i + length], set()).add(key)
    pairs = set()
    for keys in places.values():
        pairs |= set(itertools.combinations(sorted(keys), 2))
    covered = {}
    for key, text in texts.items():
        marks = [False] * len(text)
        for i in range(len(text) - length + 1):
            if len(places[text[i : i + length]]) > 1:
                marks[i : i + length] = [True] * length
        covered[key] = sum(marks)
    return pairs, covered


def patched(seed, n):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcd é日") for _ in range(120)) for _ in range(8)]
    texts = {}
    for k in range(n):
        parts = ["".join(rnd.choice("abcd é日") for _ in range(rnd.randint(0, 80))) for _ in range(3)]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(pool)
            a = rnd.randint(0, 100)
            parts.insert(rnd.randint(0, 3), p[a : a + rnd.randint(10, 120)])
        texts[k] = "".join(parts)
    return texts


@pytest.mark.parametrize("block", [500, 3])
def test_shared_pairs_and_coverage(spark, monkeypatch, block):
    monkeypatch.setattr(shared_spans, "BLOCK", block)
    texts = patched(3, 60)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs, covered = shared(texts, 32)
    got = [tuple(r) for r in shared_spans.shared_pairs(frame, 32, 10).collect()]
    assert set(got) == pairs and len(got) == len(pairs) > 10
    rows = {r["doc_id"]: r for r in shared_spans.shared_coverage(frame, 32, 10).collect()}
    assert {k: r["shared_chars"] for k, r in rows.items()} == covered
    assert all(rows[k]["n_chars"] == len(t) for k, t in texts.items())


def test_stock_phrases_make_no_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "BLOCK", 5)
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    phrase = "z" + noise(30)
    texts = {k: noise(40) + phrase + noise(40) for k in range(60)}
    texts[60], texts[61] = texts[3], texts[4][20:]
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    packed, windows = shared_spans._candidates(frame, 60, 20, "doc_id", "text")
    assert packed.count() < 60 and windows is None  # without the second minimiser all 62 documents would be in one large bucket
    assert {tuple(r) for r in shared_spans.shared_pairs(frame, 60, 20).collect()} == shared(texts, 60)[0] == {(3, 60), (4, 61)}


@pytest.mark.parametrize("n", [400, 1600])
def test_a_passage_that_many_documents_share_ships_bytes_in_proportion(spark, monkeypatch, n):
    monkeypatch.setattr(shared_spans, "BLOCK", 50)
    rnd = random.Random(n)
    noise = lambda size: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(size))
    passage = noise(120)
    frame = spark.createDataFrame([(k, noise(60) + passage + noise(60)) for k in range(n)] + [(-1, noise(400))], "doc_id long, text string")
    packed, windows = shared_spans._candidates(frame, 100, 40, "doc_id", "text")
    # rows for a document: the windows that hold the minimiser of 90 signs, 21 inside the passage and 2 * 10 at its edges
    assert windows.count() <= 41 * n and windows.groupBy("h", "g").count().filter(f"count = {n}").count() == 21
    assert packed.count() <= 12 * n  # buckets of stretches at the edges, which a few documents share by chance
    rows = shared_spans.shared_coverage(frame, 100, 40).collect()
    assert all(r["shared_chars"] >= 120 for r in rows if r["doc_id"] >= 0) and sum(r["shared_chars"] for r in rows) <= 128 * n  # chance neighbours add a few signs
    if n == 400:
        monkeypatch.setattr(shared_spans, "PAIRED", 70)
        got = [tuple(r) for r in shared_spans.shared_pairs(frame, 100, 40).collect()]
        assert len(got) == len(set(got)) == n * (n - 1) // 2


def test_shared_spans_edges(spark):
    long = "word " * 40_000
    rows = [(1, long, "z"), (2, "x" + long[:400], "z"), (3, None, None), (4, "", "z"), (None, long, "z"), (1, long, "z"), (5, "short", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    assert [tuple(r) for r in shared_spans.shared_pairs(frame).collect()] == [(1, 2)]
    rows = {r["doc_id"]: tuple(r)[1:] for r in shared_spans.shared_coverage(frame).collect()}
    assert rows[3] == rows[4] == (0, 0, 0, 0.0) and rows[5] == (5, 0, 0, 0.0) and rows[2][2] == 400
    assert rows[1][2] == len(long)
    assert shared_spans.shared_pairs(frame.limit(0)).count() == 0 and shared_spans.shared_coverage(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shared_spans.shared_pairs(frame, 10, 20)


# --- leaks ---


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["Ä", "b", "c", "日", "e9", "f", "g"])
    items = {i: " ".join(word() for _ in range(rnd.randint(0, 30))) for i in range(25)}
    docs = {i: " ".join(word() for _ in range(rnd.randint(0, 60))) for i in range(30)}
    for i in range(0, 30, 2):
        docs[i] += "\n" + rnd.choice(list(items.values())).upper().replace(" ", ", ")
    n = 6
    grams = lambda t: {tuple(w[k : k + n]) for w in [plain_words(t)] for k in range(len(w) - n + 1)}
    want = {(d, i) for d, x in docs.items() for i, y in items.items() if grams(x) & grams(y)}
    got = leakage.leaked_pairs(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), n)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_blocks_of_items_and_edges(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 7), (1, text, 7), (2, None, 7), (3, "", 7), (None, text, 7), (4, text * 3000, 7)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, text), (2, "w3 w4 w5"), (3, None), (None, text), (4, "w9 " + text), (1, text)], "item_id long, text string")
    whole = {tuple(r) for r in leakage.leaked_pairs(docs, items).collect()}
    assert whole == {(1, 1), (1, 4), (4, 1), (4, 4)}
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    assert {tuple(r) for r in leakage.leaked_pairs(docs, items).collect()} == whole
    assert leakage.leaked_pairs(docs, items.limit(0)).count() == 0 and leakage.leaked_pairs(docs.limit(0), items).count() == 0


def test_tiling_catches_reordered_passages(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(8))
    docs = spark.createDataFrame([(1, f"{b} other {a}"), (2, a[:30])], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{a} {b}")], "item_id long, text string")
    row = leakage.leaks(docs, items, 13, 5).collect()
    assert [tuple(r) for r in row] == [(1, 1, 20, 2, 28, 28)]
    assert [tuple(r) for r in leakage.leaked_items(docs, items).collect()] == [(1, 1, 1.0)]


def test_coverage_alone_decides_on_items(spark):
    parts = [" ".join(f"{p}{i}" for i in range(6)) for p in "abcd"]
    docs = spark.createDataFrame([(1, f"{parts[2]} x {parts[0]} y {parts[3]} z {parts[1]}"), (2, f"{parts[1]} x {parts[3]}"), (3, parts[0]), (4, " ".join(parts).replace("3", "3 x "))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(parts)), (2, parts[0]), (3, f"{parts[0]} {parts[0]}"), (4, "a0 a1 a2 a3")], "item_id long, text string")
    got = {tuple(r) for r in leakage.leaked_items(docs, items).collect()}
    assert got == {(1, 3, 1.0), (2, 2, 1.0), (3, 2, 0.5)}  # document 4 holds three runs of 6 words of item 1


def test_coverage_bound_drops_no_item(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    docs, items = {i: text(rnd.randint(0, 120)) for i in range(40)}, {i: text(rnd.randint(0, 14)) for i in range(60)}
    best: dict[int, list[float]] = {}
    for y, item in items.items():
        for doc in docs.values():
            one, two = textcodes.words([doc])[0], textcodes.words([item])[0]
            share = sum(n for *_, n in leakage.tiles(one, two, 3)) / max(len(two), 1)
            if share >= 0.5:
                best.setdefault(y, []).append(share)
    got = leakage.leaked_items(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), tile_words=3)
    assert {tuple(r) for r in got.collect()} == {(y, len(x), round(max(x), 6)) for y, x in best.items()} and 10 < len(best) < 60


def test_stretches_give_the_tiles_of_the_whole_text():
    rnd = random.Random(12)
    for _ in range(60):
        text, item = (textcodes.words([" ".join(rnd.choice("abcd") for _ in range(n))])[0] for n in (rnd.randint(4, 90), rnd.randint(4, 20)))
        at, ends = (textcodes.run_hashes(x, textcodes.np.array([0, len(x)]), 4)[0] for x in (text, item))
        hits = textcodes.np.flatnonzero(textcodes.np.isin(at, ends))
        short = leakage.shared_stretches(text, hits, item, 4)
        assert [x[2] for x in leakage.tiles(short, item, 4)] == [x[2] for x in leakage.tiles(text, item, 4)]


# --- cuts ---


def fences(text):
    out, at, opened = [], 0, None
    for line in text.split("\n"):
        if line.startswith("```"):
            if opened is None:
                opened = at
            else:
                out.append((opened, at + len(line)))
                opened = None
        at += len(line) + 1
    return out


def bad_cut(text, p, most):
    if not 0 < p < len(text):
        return False
    ok = lambda c: c.isalnum() and not KANA.match(c)
    a = b = p
    if ok(text[p - 1]) and ok(text[p]):
        while a and ok(text[a - 1]):
            a -= 1
        while b < len(text) and ok(text[b]):
            b += 1
        if b - a <= most:
            return True
    return any(s < p < e and e - s <= most for s, e in fences(text))


def messy(rnd):
    parts = ["Some words here. ", "日本語のテキスト。", "\n\n", "x" * rnd.randint(1, 90), " ", "\n```py\ncode = 1\n```\n", "\n```\n" + "long_code()\n" * rnd.randint(1, 9) + "```\n", "éá, ", "# Title\n", "```"]
    return "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60)))


def test_bisection_keeps_every_rule():
    rnd = random.Random(4)
    for _ in range(150):
        text, most = messy(rnd), rnd.randint(20, 120)
        overlap = rnd.randint(0, most // 3)
        pieces = boundary_split.bisect(text, most, overlap)
        end = 0
        for n, (a, b) in enumerate(pieces):
            assert 0 < b - a <= most and a <= end and end - a <= overlap and b > end
            assert not bad_cut(text, a, most) and not bad_cut(text, b, most)
            assert n or a == 0
            end = b
        assert end == len(text)
    with pytest.raises(ValueError):
        boundary_split.bisect("x", 0, 0)


def test_pieces_and_faults(spark, monkeypatch):
    rnd = random.Random(8)
    docs = {f"d{i}": messy(rnd) * 4 for i in range(12)}
    frame = spark.createDataFrame([(k, t, 60, 10, "s") for k, t in docs.items()] + [("n", None, 60, 10, "s"), ("e", "", 60, 10, "s"), ("m", "x" * 100, None, 1, "s")], "doc_id string, text string, max_chars int, overlap_chars int, char_start string")
    pieces = boundary_split.split_oversized(frame).collect()
    assert {r["doc_id"] for r in pieces} == {k for k, t in docs.items() if len(t) > 60}
    assert all(docs[r["doc_id"]][r["char_start"] : r["char_end"]] == r["text"] for r in pieces)
    params = {"max_chars": "60", "overlap_chars": "10"}
    schema = "chunk_id string, doc_id string, chunk_set_id string, text string, char_start int, char_end int, ordinal int, chunker_params map<string,string>"
    rows = [(f"{r['doc_id']}/{r['piece']}", r["doc_id"], "s", r["text"], r["char_start"], r["char_end"], r["piece"], params) for r in pieces]
    texts = spark.createDataFrame(list(docs.items()) + [("big", "word " * 900)], "doc_id string, text string")
    assert boundary_split.faulty_chunks(texts, spark.createDataFrame(rows, schema)).count() == 0
    bad = [
        ("long", "big", "s", ("word " * 900)[:65], 0, 65, 0, params), ("gap", "big", "s", "word ", 70, 75, 1, params), ("over", "big", "s", ("word " * 900)[60:80], 60, 80, 2, params),
        ("inside", "big", "s", "ord word ", 81, 90, 3, params), ("other", "big", "s", "else", 90, 94, 2000, params), ("nulls", "big", None, None, None, None, None, None), ("lost", "no such", "s", "a", 0, 61, 0, params),
        ("long", "big", "s", ("word " * 900)[:65], 0, 65, 0, params),
    ]
    got = {r["chunk_id"]: tuple(r)[1:] for r in boundary_split.cut_faults(texts, spark.createDataFrame(rows + bad, schema)).collect() if any(tuple(r)[1:])}
    assert got == {
        "long": (True, False, False, False, False, False), "gap": (False, False, False, False, True, False), "over": (False, False, False, False, False, True),
        "inside": (False, False, True, False, True, False), "other": (False, True, False, False, False, False), "lost": (True, False, False, False, False, False),
    }
    assert boundary_split.faulty_chunks(texts.limit(0), spark.createDataFrame([], schema)).count() == 0
    monkeypatch.setattr(boundary_split, "JUDGED", 2)  # a document comes again for each two of its chunks
    again = {r["chunk_id"]: tuple(r)[1:] for r in boundary_split.cut_faults(texts, spark.createDataFrame(rows + bad, schema)).collect() if any(tuple(r)[1:])}
    assert again == got
    checks = boundary_split.piece_checks(frame.filter("max_chars is not null").withColumn("chunk_set_id", F.lit("s")).drop("char_start")).collect()
    assert {r["doc_id"] for r in checks} == {r["doc_id"] for r in pieces} and all((r["first_start"], r["last_end"], r["faults"]) == (0, len(docs[r["doc_id"]]), 0) for r in checks)


# --- token budgets ---


def corpus(n=900):
    rnd = random.Random(6)
    words = {"en": "the limit of each renewable contract is settled before month 12".split(), "ru": "договор продлевается каждый месяц без уведомления".split(), "ja": ["契約は", "毎月", "更新", "されます。"]}
    return [(f"c{i}", rnd.choice(list(words)), " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 90)))) for i in range(n) for lang in [rnd.choice(list(words))]]


def test_unusable_counts_are_exact(spark):
    rnd = random.Random(1)
    rows = [(i, t, rnd.choice([None, 0, -3, 5, len(t) // 4, len(t) // 2, len(t) // 9 + 1])) for i, _, t in corpus()] + [("null", None, 3), ("empty", "", 1), (None, "a", 1), ("none", None, None), ("c0", "one two", 900)]
    frame = spark.createDataFrame(rows, "chunk_id string, text string, token_count int")
    true = encode.ByteBpe.load(encode.DEFAULT_VOCABULARY).count([t for _, t, _ in rows])
    want = {i for (i, _, told), n in zip(rows, true.tolist()) if i and (told is None or told <= 0 or told > 2 * n or 2 * told < n)}
    assert {r["chunk_id"] for r in token_budget.unusable_counts(frame).collect()} == want
    assert token_budget.unusable_counts(frame.limit(0)).count() == 0


def test_budget_is_near_the_truth(spark):
    rows = corpus()
    docs = spark.createDataFrame([(f"d{i}", "k", t, {"lang": lang.upper(), "domain": " Legal "}) for i, lang, t in rows[:300]] + [("dc0", "k", rows[0][2], {"lang": rows[0][1].upper(), "domain": " Legal "}), ("dn", "k", None, None)], "doc_id string, corpus string, text string, meta map<string,string>")
    chunks = spark.createDataFrame([(i, f"dc{k % 300}", "k", t) for k, (i, _, t) in enumerate(rows)], "chunk_id string, doc_id string, corpus string, text string")
    out = {(r["record_kind"], r["language"], r["domain"]): (r["n_records"], r["tokens"]) for r in token_budget.token_budget(docs, chunks).collect()}
    assert out[("doc", "und", "unknown")] == (1, 0)
    assert sum(n for (kind, _, _), (n, _) in out.items() if kind == "child") == 900
    bpe = encode.ByteBpe.load(encode.DEFAULT_VOCABULARY)
    for lang in ("en", "ru", "ja"):
        true = int(bpe.count([t for _, x, t in rows[:300] if x == lang]).sum())
        assert abs(out[("doc", lang, "legal")][1] / true - 1) < 0.05
    assert token_budget.token_budget(docs.limit(0), chunks.limit(0)).count() == 0


def test_a_text_unlike_the_sample_is_tokenized(spark):
    rnd = random.Random(4)
    plain = [(f"c{i}", " ".join(rnd.choice(["the", "house", "and", "water", "time", "people"]) for _ in range(80)), 80) for i in range(300)]
    odd = " ".join("".join(rnd.choice("bcdfghjkqxz") for _ in range(9)) for _ in range(2500))
    chunks = lambda told: spark.createDataFrame([*plain, ("odd", odd, told)], "chunk_id string, text string, token_count long")
    none = token_budget.LanguageModel.of(token_budget.np.zeros((6, token_budget.PAIRS)))
    model = token_budget.fit(chunks(1).filter("chunk_id != 'odd'"), none)
    guess, _, known = model.predict([odd, plain[0][1]])
    true = int(encode.ByteBpe.load(encode.DEFAULT_VOCABULARY).count([odd])[0])
    assert true > 2 * int(guess[0]) and known.tolist() == [False, True]
    assert [r["chunk_id"] for r in token_budget.unusable_counts(chunks(int(guess[0]))).collect()] == ["odd"]


def test_sample_takes_all_lengths_and_each_text_once(spark):
    rnd = random.Random(3)
    short = [("the same text again and again " * 3,)] * 3000 + [(f"{i} " + "word " * 20,) for i in range(2000)]
    long = [(" ".join(str(rnd.random()) for _ in range(4000)),) for _ in range(3)]
    frame = spark.createDataFrame(short + long, "text string")
    got = token_budget._portion(frame, 100, token_budget.F.floor(token_budget.F.log2(token_budget.F.octet_length("text") + 1))).collect()
    texts = [r["text"] for r in got]
    assert len(set(texts)) == len(texts) <= 130 and {t for t, in long} <= set(texts)


def test_languages_are_told_on_held_out_documents(spark):
    import glob

    import pandas as pd

    path = "/root/testdata/sf0.01/corpus_docs.parquet"
    if not glob.glob(path):
        pytest.skip("no test tables")
    docs = pd.read_parquet(path, columns=["doc_id", "text", "meta"]).drop_duplicates("doc_id")
    docs["lang"] = docs["meta"].map(lambda m: dict(m).get("lang"))
    known = docs[docs["lang"].isin(token_budget.LANGUAGES)]
    taught, held = known[known["doc_id"].str[-1] < "8"], known[known["doc_id"].str[-1] >= "8"]
    model = token_budget.fit_languages(spark.createDataFrame(taught[["text", "lang"]]))
    told = [token_budget.LANGUAGES[k] for k in model.tell(list(held["text"]))]
    assert (pd.Series(told, index=held.index) == held["lang"]).mean() > 0.97 and len(held) > 50
