import glob
import os

import pandas as pd
import pytest

from gleanery.llm import encode, leakage, queries, sql, textcodes

from .test_encode import plain_ids as plain
from .test_texts import bad_cut

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def table(name, *columns):
    return pd.read_parquet(f"{FOLDER}/{name}.parquet", columns=list(columns))


@pytest.mark.parametrize("name", list(sql.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    engine = pytest.importorskip("duckdb").connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        engine.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    columns = sorted(got.columns)
    want = engine.sql(sql.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = want.select(*columns).fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(rows, key=repr) and rows


def test_every_query_has_sql_or_another_test_here():
    assert set(queries.queries()) - set(sql.oracle_sql()) == {"p1_found", "p1_token_budget", "p4_pieces", "p6_ids", "p7_items"}


def test_p1_found_is_exact(spark):
    rows = table("chunks_child", "chunk_id", "text", "token_count").drop_duplicates()
    true = rows["text"].map(lambda t: len(plain(t or "")))
    told = rows["token_count"]
    want = set(rows["chunk_id"][told.isna() | (told <= 0) | (told > 2 * true) | (2 * told < true)]) - {None}
    got = [r["chunk_id"] for r in queries.queries()["p1_found"](spark, FOLDER).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_p1_budget_is_near_the_tokenized_totals(spark):
    got = queries.queries()["p1_token_budget"](spark, FOLDER).toPandas()
    for kind, name, key in (("doc", "corpus_docs", "doc_id"), ("child", "chunks_child", "chunk_id")):
        rows = table(name, key, "corpus", "text").drop_duplicates(key)
        true = rows["text"].map(lambda t: len(plain(t or ""))).groupby(rows["corpus"]).sum()
        told = got[got["record_kind"] == kind].groupby("corpus")["tokens"].sum()
        assert ((told / true - 1).abs() < 0.06).all() and abs(told.sum() / true.sum() - 1) < 0.03
    assert (got["error"] >= 0).all()


def test_p4_pieces_keep_the_rules(spark):
    docs = table("corpus_docs", "doc_id", "text").drop_duplicates("doc_id").set_index("doc_id")["text"]
    chunks = table("chunks_child", "doc_id", "chunker_params").drop_duplicates("doc_id").set_index("doc_id")["chunker_params"].map(dict)
    got = queries.queries()["p4_pieces"](spark, FOLDER).toPandas()
    assert set(got["doc_id"]) == {d for d, p in chunks.items() if len(docs[d] or "") > int(p["max_chars"])}
    for doc, pieces in got.groupby("doc_id"):
        text, most, shared, end = docs[doc], int(chunks[doc]["max_chars"]), int(chunks[doc]["overlap_chars"]), 0
        for r in pieces.sort_values("piece").itertuples():
            assert r.text == text[r.char_start : r.char_end] and 0 < r.char_end - r.char_start <= most and end - shared <= r.char_start <= end < r.char_end
            assert not bad_cut(text, r.char_start, most) and not bad_cut(text, r.char_end, most)
            end = r.char_end
        assert end == len(text)


def test_p6_ids_equal_a_plain_encoder(spark):
    want = {d: plain(t or "") for d, t in table("documents", "doc_id", "text").itertuples(index=False)}
    got = {r["doc_id"]: r["ids"] for r in queries.queries()["p6_ids"](spark, FOLDER).collect()}
    assert got == want


def test_p7_items_equal_tiling_of_every_pair(spark):
    texts, items = (table(n, k, "text").dropna().drop_duplicates() for n, k in (("documents", "doc_id"), ("heldout_items", "item_id")))
    words, offsets = textcodes.words(list(texts["text"]))
    best: dict[int, list[float]] = {}
    for item, text in items.itertuples(index=False):
        own = textcodes.words([text])[0]
        runs = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for a, b in zip(offsets, offsets[1:]):
            doc = words[a:b]
            if runs and any(tuple(doc[i : i + 5]) in runs for i in range(len(doc) - 4)):
                share = sum(n for *_, n in leakage.tiles(doc, own, 5)) / len(own)
                if share >= 0.5:
                    best.setdefault(item, []).append(share)
    got = {tuple(r) for r in queries.queries()["p7_items"](spark, FOLDER).collect()}
    assert got == {(i, len(x), round(max(x), 6)) for i, x in best.items()} and got
