"""What findings of a review named, on small tables: each of these failed before."""

import datetime as dt
import math
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lookback.operators import cases
from lookback.plans import cases as _, index, queries  # noqa: F401
from lookback.plans.registry import ORACLE_SQL, QUERIES


def stored(folder, **tables):
    """The tables as a query reads them, and a DuckDB that has them."""
    duck = duckdb.connect()
    for name, frame in tables.items():
        frame.to_parquet(folder / f"{name}.parquet", index=False)
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return duck


def same(spark, folder, duck, name):
    got, want = QUERIES[name](spark, str(folder)).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want) and len(got)
    return got


def test_titles_keep_what_their_sql_keeps(spark, tmp_path):
    titles = ["a &quot;b&quot;", "a b", "a &amp; b", "<b>a</b> b", "²x Ａ", "2x a", "İstanbul", "istanbul", "ΟΔΟΣ", "οδος", "Straße", "STRASSE", "ﬁn", "é ǅ", "é ǆ", "ﬃ", "", "\n a \x0b b\t"]
    html = [f"<title id=1>{t}</title>" for t in titles] + ["<TITLE>a b</TITLE>", "<title>a b", "none", None]
    pages = pd.DataFrame({"page_id": range(len(html)), "url": ["https://a", "http://b"] * (len(html) // 2), "html": html})
    same(spark, tmp_path, stored(tmp_path, pages=pages), "near_identical_titles")


def test_similar_documents_meet_by_every_word(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": range(8), "text": ["the cat", "the the dog", "a cat is there", "no dog", "it will be", "cat cat cat", "", None]})
    asked = pd.DataFrame({"item_id": [1, 2, 3], "text": ["The", "it was the cat", "there is no dog"]})
    got = same(spark, tmp_path, stored(tmp_path, documents=docs, benchmark=asked), "similar_documents")
    assert set(got["query"]) == {1, 2, 3}


def test_similar_documents_keep_odd_letters_and_keys(spark, tmp_path):
    import random

    rng = random.Random(3)
    words = ["the"] * 30 + ["of"] * 9 + [f"w{i}" for i in range(40)] + ["İstanbul", "\u212aelvin", "ISTANBUL", "x\u0130y", "kelvin"]
    # ids repeat with texts of other lengths, and lack; so do those of queries
    ids = [i % 220 if i % 11 else None for i in range(400)]
    docs = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": [None if i % 50 == 7 else " ".join(rng.choices(words, k=rng.choice([1, 2, 9, 30]))) for i in range(400)]})
    items = [1, 1, None, 2, None, 3, 4, 4, 5]
    texts = ["the of", "the of istanbul w1", "the \u0130stanbul kelvin", "the", "of w2 w3", "the of w4 xiy", "w5 w6 the", "w5 w6 the", " ".join(f"w{i}" for i in range(40))]
    asked = pd.DataFrame({"item_id": pd.array(items, "Int64"), "text": texts})
    want = stored(tmp_path, documents=docs, benchmark=asked).execute(ORACLE_SQL["similar_documents"]).fetchall()
    got = [tuple(r) for r in QUERIES["similar_documents"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 30 and any(r[1] is None for r in got)


def test_a_letter_of_two_lower_cases_is_one(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": range(3), "text": ["İstanbul of", "\u0130", "stanbul"]})
    same(spark, tmp_path, stored(tmp_path, documents=docs, benchmark=pd.DataFrame({"item_id": [1, 2], "text": ["istanbul", "stanbul"]})), "similar_documents")


def test_the_target_model_reads_every_trusted_document(spark):
    from lookback.llm import quality

    n = 120_000
    ids = F.col("id") - 1_000  # on both sides of 0
    docs = spark.range(n).select(ids.alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 7 == 0, "y").otherwise("z").alias("text"))
    docs = docs.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'x' AS text"))
    labels = spark.range(n).select(ids.alias("doc_id"), F.when(F.col("id") % 11 < 6, 1).otherwise(0).alias("quality"), F.when(F.col("id") % 13 == 0, 1).alias("toxic"))
    raw, target = Counter(x=1), Counter()
    for i in range(n):
        word = "x" if i % 3 == 0 else "y" if i % 7 == 0 else "z"
        raw[word] += 1
        target[word] += i % 11 < 6 and i % 13 != 0
    k = quality.PRIOR * quality.BUCKETS
    p_raw = {w: (c + quality.PRIOR) / (raw.total() + k) for w, c in raw.items()}
    want = sorted(math.log((target[w] + k * p_raw[w]) / (target.total() + k) / p_raw[w]) for w in raw)
    assert sum(target.values()) > 50_000
    for bitmaps in (quality.BITMAPS, 0):
        assert sorted(r["ratio"] for r in quality.log_ratios(docs, labels, bitmaps).collect()) == pytest.approx(want, abs=1e-12)


def test_known_evidence_is_listed_as_by_rows(spark):
    frame, day = spark.createDataFrame, dt.date.fromisoformat
    n = 300
    text = frame([(k, f"text {k}") for k in range(n)], "claim long, text string")
    asked = frame([(1, list(range(n))), (2, [5, 5, 299, 7]), (3, [])], "question long, evidence array<long>")
    reports = frame([(day(f"2026-03-{1 + k % 20:02d}"), [k]) for k in range(n)] + [(None, [7])], "day date, claims array<long>")
    rows = [(k, 1 + k % 3, day(f"2026-03-{1 + k % 28:02d}"), "prose", [k, (k * 7) % n, 299]) for k in range(200)]
    rows += [(7, 1, day("2026-03-09"), "prose", [1]), (900, None, day("2026-03-09"), "prose", [1]), (901, 1, None, "prose", [1, None])]
    logs = frame(rows, "log long, question long, day date, text string, claims array<long>")
    of, sources = frame([(1, 1)], "claim long, source long"), frame([(1, "a", "u", "x")], "source long, title string, url string, text string")
    run = lambda bound: cases.prose_cases(logs, text, of, sources, asked, reports, bound=bound)
    lists = run(cases.BOUND)
    assert sorted(map(str, lists.collect())) == sorted(map(str, run(0).collect())) and lists.filter("size(known) > 100").count() > 20


def test_a_stored_index_scores_block_by_block(spark, tmp_path, monkeypatch):
    from lookback.operators import index

    monkeypatch.setattr(index, "DOCUMENTS", 7)
    monkeypatch.setattr(index, "QUERIES", 5)
    words = "the of and cat dog éa b1 straße x2".split()
    docs = pd.DataFrame({"doc_id": range(60), "text": [" ".join(words[j] for j in range(9) if (i * (j + 3)) % (j + 2) < 2) for i in range(60)]})
    docs.loc[[3, 9], "text"] = [None, ""]
    pages = pd.DataFrame({"page_id": [*range(20), 7], "html": [f"<title>{' '.join(words[j] for j in range(7) if i % (j + 2) == 0)}</title>" for i in range(20)] + ["<title>the cat</title>"]})
    got = same(spark, tmp_path, stored(tmp_path, documents=docs.assign(source="s"), pages=pages), "stored_index_search")
    assert got.groupby("query").size().max() == 5


def test_a_full_store_of_pieces_keeps_the_first_ones(spark):
    from lookback.llm import tokenbin, tokens

    pieces = tokens.Pieces(tokens.vocabulary("byte_bpe_50k.json"))
    first = {x: pieces[x] for x in ("the", " cat", " Straße")}
    pieces[" seldom"]
    pieces.shorten(3)
    assert pieces == first
    assert [list(x) for x in tokenbin.in_steps([b"ab", b"", b"abc", b"a"], 3)] == [[b"ab", b"", b"abc"], [b"a"]] and not list(tokenbin.in_steps([], 3))
    encoded = spark.createDataFrame([(bytes([1, 0, 2, 0]),), (b"",), (bytes([1, 0]),)], "ids binary")
    assert {r["id"]: r["n"] for r in tokenbin.id_counts(encoded, "<u2").collect()} == {1: 2, 2: 1}


def test_prose_reads_its_tables_once_and_moves_no_excerpt(spark, tmp_path):
    n = 60
    tables = {
        "orders": pd.DataFrame({"o_orderkey": range(n), "o_custkey": [k % 3 for k in range(n)], "o_orderstatus": ["F", "O", "P"] * (n // 3), "o_orderdate": pd.to_datetime([f"1995-01-{1 + k % 20:02d}" for k in range(n)]).astype("datetime64[us]"), "o_orderpriority": ["1-URGENT"] * n}),
        "lineitem": pd.DataFrame([(k, (k * 7 + 20 * j) % 90, (k + j) % 9, j) for k in range(n) for j in range(5)], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]),
        "part": pd.DataFrame({"p_partkey": range(90), "p_name": [f"part {k}" for k in range(90)], "p_size": [7 if k == 5 else 40 for k in range(90)]}),
        "supplier": pd.DataFrame({"s_suppkey": range(9), "s_name": [f"Supplier#{k:09d}" for k in range(9)]}),
    }
    got = same(spark, tmp_path, stored(tmp_path, **tables), "prose_cases")
    assert (got["known"] != "").sum() > 10
    found = QUERIES["prose_cases"](spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]  # all that comes out is made of what was written
    assert "excerpt" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_known_evidence_as_one_text_is_the_list_joined(spark):
    frame, day = spark.createDataFrame, dt.date.fromisoformat
    text = frame([(k, f"text {k}") for k in range(9)], "claim long, text string")
    asked = frame([(1, [8, 3, 3, 5, 0, 7]), (2, [4, 6])], "question long, evidence array<long>")
    reports = frame([(day("2026-03-01"), list(range(7))), (day("2026-03-05"), [7, 8])], "day date, claims array<long>")
    rows = [(1, 1, "2026-03-09", [3, 5]), (2, 1, "2026-03-05", [8]), (3, 1, "2026-03-01", [1]), (4, 2, "2026-03-09", [4, 6]), (5, 2, "2026-03-09", [3]), (5, 1, "2026-03-09", [7]), (6, None, "2026-03-09", [1])]
    logs = frame([(k, q, day(d), "prose", c) for k, q, d, c in rows], "log long, question long, day date, text string, claims array<long>")
    of, sources = frame([(3, 1), (5, 2)], "claim long, source long"), frame([(2, "b", "u", "xyz"), (1, "a", "u", "x")], "source long, title string, url string, text string")
    told = {"size": F.length("text")}
    got = {r["log"]: r for r in cases.prose_cases(logs, text, of, sources, asked, reports, told=told, joined="|").collect()}
    want = {1: [8, 0, 7], 2: [3, 3, 5, 0], 3: [], 4: [], 5: None, 6: []}
    assert set(got) == set(want) and sorted(got[5]["known"].split("|")) == ["text 0", "text 3", "text 3", "text 4", "text 5", "text 6", "text 8"]
    assert all(got[k]["known"] == "|".join(f"text {c}" for c in v) for k, v in want.items() if v is not None)
    assert [tuple(s) for s in got[1]["sources"]] == [(1,), (3,)] and [c["source"] for c in got[1]["claims"]] == [1, 2]
