import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from lookback.llm import shared

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("the shared tables aren't here")
    docs = shared.table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.materialize(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0
    assert docs.select("sequence_id", "offset").distinct().count() == docs.count()


EN, FR = "the of and to in that with from this which have an", "le la les des une dans pour avec sur est qui au"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, offset long"


def corpus():
    rng = random.Random(6)
    text = lambda words, n=70: " ".join(rng.choice(words.split()) + str(rng.randint(0, 999) or "") for _ in range(n))
    rows = [(k, text(EN if k % 3 else FR), "en" if k % 3 else "fr", f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, rows[k][1] if k % 2 else rows[k][1] + " more", rows[k][2], None) for k in range(8)]  # copies, exact and near
    rows += [(5, text(EN), "en", "s0"), (5, rows[7][1], "en", "s1"), (None, rows[9][1], "en", "s1"), (None, text(EN), None, "s2"), (None, None, None, None), (200, "", "en", "s0")]
    rows += [(300, text(EN, 30_000), "en", "s0"), (301, "12 !? ²", None, "s0")]
    return [(*r, len(r[1] or ""), "clash", 7, 9) for r in rows]


def plain_near_dedup(rows):
    """How many rows of each group of near-duplicates stay: one; groups by all pairs of rows, whatever their doc_ids."""
    sets = []
    for r in rows:
        words = (r["text"] or "").encode().lower().split()
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_stages_on_odd_rows(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        given = docs.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = shared.materialize(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        got = docs.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert docs.columns == SCHEMA.replace(",", "").split()[::2]
        assert not {tuple(r) for r in got} - {tuple(r) for r in given}
        if name == "language_id":
            assert len(got) == len(given) - 3  # null, empty, no letter
        if name == "quality_rules":
            assert {r["doc_id"] for r in got} >= {300, None, 5} and len(got) >= 0.9 * len(given)
        if name == "near_dedup":
            label, left = plain_near_dedup(given), Counter(tuple(r) for r in got)
            groups = {}
            for r, k in zip(given, label):
                groups.setdefault(k, []).append(tuple(r))
            assert len(got) == len(groups) and all(sum(left[r] for r in set(g)) == 1 for g in groups.values())
        if name == "mixing":
            repeats = Counter(tuple(r) for r in got)
            assert max(repeats.values()) <= 2 * max(Counter(tuple(r) for r in given).values())
    assert {c for c in docs.columns} >= {"doc_id", "piece", "sequence_id", "offset"}
    whole = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert whole == Counter(r["doc_id"] for r in given)
