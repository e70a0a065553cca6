"""Spelling variants against a plain computation over all pairs."""

import random
import re
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lookback.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long"


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(rows: list[tuple], times: int = 5) -> dict:
    counts: dict[str, int] = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = [n, len(others), best if best and words[best] >= times * n else None]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return out


def found(df) -> dict:
    rows = df.collect()
    assert len(rows) == len({r["word"] for r in rows})
    for r in rows:
        assert (r["form"] is None) == (r["form_n"] is None)
    return {r["word"]: [r["n"], r["n_near"], r["form"], r["root"]] for r in rows}


def corpus() -> list[tuple]:
    rng = random.Random(5)
    base = ["banana", "bananas", "Straße", "straßen", "çédille", "tomorrow", "aaaaaa", "aaaaaaa", "aaaaaab", "abababab", "x" * 40]
    rows: list[tuple] = [(None, "banana banana"), (7, None), (8, ""), (9, "12 34 ÷×÷×÷× ."), (9, "Banana,banana;BANANA")]
    for k in range(400):
        words = rng.choices(base, k=12)
        if k % 4 == 0:
            w = rng.choice(base)
            i = rng.randrange(len(w))
            words.append(w[:i] + rng.choice(["", "q", "ü"]) + w[i + rng.randint(0, 1) :])
        rows.append((k % 390, " ".join(words)))
    rare = {"bananna": 40, "bannanna": 6, "bananne": 7, "banane": 30, "tomorow": 12, "tomorrov": 5, "Çédille": 8, "strasse": 9, "abababac": 11, "aaaaac": 5, "aaaaacc": 6}
    rows += [(500 + k, f"{w}. {w}") for w, n in rare.items() for k in range(n // 2 + 1)]
    return rows + [rows[-1]] * 9


def test_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], SCHEMA).repartition(3)
    want = plainly(rows)
    assert sum(v[2] is not None for v in want.values()) > 5 and any(want[v[2]][2] for v in want.values() if v[2])
    assert found(spelling.variants(docs)) == want
    assert found(spelling.variants(docs, most=3)) == want  # most partitions are dealt out again


def test_equals_sql_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in corpus()], SCHEMA)
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    want = {r[0]: [r[3], r[4], r[1], r[2]] for r in c.execute(f"SELECT word, form, root, n, n_near FROM ({spelling.OP12_SQL})").fetchall()}
    assert found(spelling.variants(docs)) == want


def test_empty_table_and_texts(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, None, None), (None, "", None, None)], SCHEMA)).collect() == []


def test_one_prefix_of_most_words_is_dealt_out(spark):
    letters = "abcdefghij"
    words = [("counter" + a + b + c, 5) for a in letters for b in letters for c in letters]
    made = spark.createDataFrame(words, "word string, n long")
    assert spelling.partitions(made, 50).groupBy(*spelling.KEY).count().filter((F.col("count") > 50) & (F.col("end") - F.col("start") > 1)).isEmpty()
    pairs = spelling.near_pairs(made, 50)
    assert pairs.count() == pairs.distinct().count() == 1000 * 27  # three places with nine other letters each


def test_a_very_long_word(spark):
    long = "ab" * 10_000
    made = spark.createDataFrame([(long, 9), (long[:777] + long[778:], 8), (long + "a", 7), (long[:-1] + "c", 6)], "word string, n long")
    got = {(len(r[0]), len(r[2])) for r in spelling.near_pairs(made).collect()}
    assert got == {(20_000, 19_999), (19_999, 20_000), (20_000, 20_001), (20_001, 20_000), (20_000, 20_000)}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab", min_size=3, max_size=5), max_size=24))
def test_active_nodes_find_all_pairs(strings):
    listed = sorted(strings)
    got = list(spelling.Trie(listed).pairs())
    assert sorted(got) == [(i, j) for i in range(len(listed)) for j in range(i + 1, len(listed)) if near(listed[i], listed[j])]
