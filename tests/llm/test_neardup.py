"""Near-duplicates against all pairs of a small fixture."""

import random

from lookback.llm import neardup

SCHEMA = "doc_id long, text string, kept string"


def truth(rows, width, percent):
    sets = {}
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        n = min(width, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def family(n, seed, size=60, edits=8):
    """Copies of one text with up to so many words changed: some near it, some only near each other, some apart."""
    rng = random.Random(seed)
    base = [f"w{seed}_{i}" for i in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(size)] = f"x{rng.randrange(40)}"
        out.append(" ".join(words))
    return out


def check(spark, rows, width, percent=80):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), width, percent).collect()}
    assert got == truth(rows, width, percent)


def test_families_and_odd_texts(spark):
    texts = family(120, 1) + family(30, 2, size=20, edits=3) + ["", None, " \n", "one", "ONE", "one two", "One\x0btwo", "a b c", "a b c", "é É"] + ["long " * 3000 + str(k) for k in range(2)]
    check(spark, [(i, t, "clash") for i, t in enumerate(texts)], 2)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    check(spark, [(i, t, None) for i, t in enumerate(family(80, 3, edits=10))], 2)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f", None), (3, "a b c d e f", None), (3, "a b c d e f", None), (2, "A b c d e f", None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(2, 2, True), (3, 2, False), (3, 2, False), (None, None, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    a, b, c = "a b c d e f", "x y z u v w", "k l m n o p"
    rows = [(5, a, None), (5, b, None), (3, b, None), (9, a, None), (7, c, None), (7, None, None), (8, "", None), (8, " ", None), (2, c, None), (2, None, None)]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 2), (2, 2), (8, 8)}


def test_likelihood_is_near_the_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for common in (1800, 1000, 200):  # of 2 * 2000 - common
        a, b = x[:2000], x[2000 - common : 4000 - common]
        b = np.concatenate([b, rng.integers(0, 1 << 63, 2000 - len(b), dtype=np.uint64)])
        j = common / (4000 - common)
        est = neardup.likeliest(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(est - j) < 0.15
    merged = np.maximum(neardup.sketch(x[:1500]), neardup.sketch(x[1500:]))
    assert (merged == neardup.sketch(x)).all()
