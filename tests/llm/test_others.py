"""The remaining operators on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lookback.llm import langid, licenses, mixing, quality, shared, suffixtree, vafile, warc

EN, FR = "the of and to in that with from this which have", "le la les des une dans pour avec sur est qui"


def docs_of(spark, rows, schema="doc_id long, text string, lang string, source string, kept string"):
    return spark.createDataFrame(rows, schema)


# language


def texts(words, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(words.split(), 60)) for _ in range(n)]


def test_language(spark):
    model = langid.train([(t, "en") for t in texts(EN, 30, 1)] + [(t, "fr") for t in texts(FR, 30, 2)])
    rows = [(1, texts(EN, 1, 3)[0], None, None, None), (2, texts(FR, 1, 4)[0], None, None, None), (3, None, None, None, None), (4, "² 12 ½ Ⅷ !?", None, None, None), (None, "", None, None, None), (2, texts(EN, 1, 5)[0] * 40, None, None, None)]
    got = langid.predict(docs_of(spark, rows), model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: (r["doc_id"] or 0, len(r["text"] or "")))] == ["und", "en", "fr", "en", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got)
    mixed = (texts(EN, 1, 6)[0] + " " + texts(FR, 1, 7)[0]).split()
    p, _ = langid.posteriors(model.scores(mixed).astype(float), np.array([len(mixed)]), model.start, model.move)
    assert (p.argmax(axis=1) == np.repeat([0, 1], 60)).mean() > 0.95
    assert langid.predict(docs_of(spark, rows).limit(0), model).count() == 0
    assert langid.predict(docs_of(spark, rows[:1]), langid.train([])).first()["lang_pred"] == "und"


def test_language_learns_from_whole_texts_of_all_labels(spark):
    # what tells the two long texts apart begins after word 256 and 50,000 characters; 70 languages; a run without spaces
    common, rng = "ka ke ki ko ku " * 4_000, np.random.default_rng(9)
    rows = [(k, common + EN if k % 2 else common + FR, "en" if k % 2 else "fr", None, None) for k in range(4)]
    names = ["".join(rng.choice(list("bcdfghjklmnpqrstvwz"), 6)) for _ in range(70)]
    rows += [(100 + k, f"{w} {w}{w} {w[::-1]} " * 3, f"l{k}", None, None) for k, w in enumerate(names)]
    picked = langid.sample(docs_of(spark, rows))
    assert len(picked) == len(rows) and len({y for _, y in picked}) == 72
    model = langid.train([r for r in picked if r[1] in ("en", "fr")])
    assert {model.languages[k] for k in model.scores(EN.split() + FR.split()).argmax(axis=1)[[0, 10, -1]]} == {"en", "fr"}
    for run in ("\u4e2d\u6587" * 50, "x" * 27, "\u0e01" * 9 + "\U00010400" * 9, "a" * 26):
        assert "".join(langid.words_of(run)) == run.lower() and all(len(w.encode()) <= langid.WIDTH for w in langid.words_of(run))
    middle = langid.train([("\u4e2d" * 20 + y * 60 + "\u4e2d" * 20, n) for y, n in (("\u3042", "ja"), ("\u6587", "zh")) for _ in range(30)])
    asked = docs_of(spark, [(1, "\u4e2d" * 20 + "\u3042" * 60 + "\u4e2d" * 20, None, None, None), (2, "\u4e2d" * 20 + "\u6587" * 60 + "\u4e2d" * 20, None, None, None)])
    assert [r["lang_pred"] for r in langid.predict(asked, middle).orderBy("doc_id").collect()] == ["ja", "zh"]


def test_language_is_not_trained_by_the_driver(spark, monkeypatch):
    rows = [(k, t, "fr" if k % 2 else "en", None, None) for k in range(40) for t in texts(FR if k % 2 else EN, 1, k)]
    docs = docs_of(spark, rows)
    want = langid.train(langid.sample(docs.filter(shared.crc_remainder(F.col("doc_id"), 3) != 1)))
    monkeypatch.setattr(langid, "sample", lambda *_: pytest.fail("texts went to the driver"))
    got = langid.fit(docs)
    assert got.languages == want.languages and got.lexicon == want.lexicon
    assert (got.weights == want.weights).all() and (got.start == want.start).all() and (got.move == want.move).all()
    assert langid.fit(docs.limit(0)).languages == [] and langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    scores, start, move = rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = math.exp(start[path[0]] + sum(scores[k, y] for k, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        for k, y in enumerate(path):
            want[k, y] += w
    got, moves = langid.posteriors(scores, np.array([4]), start, move)
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True)) and moves.sum() == pytest.approx(3)


def test_language_held_out(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the shared tables aren't here")
    got = langid.op1_language(spark, "/root/testdata/sf0.01").join(shared.table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


# quality


def spark_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_quality_equals_brute_force(spark):
    good, bad = "the cat sat on the mat and ran off again today ", "*** $$$ || buy!! now!! "
    rows = [(k, " ".join(f"{w}{k if j % 7 == 0 else ''}" for j, w in enumerate((good * 8).split())), None, None, "clash") for k in range(12)]
    rows += [(20 + k, " ".join(f"{w}{j}" for j, w in enumerate((bad * 15).split())), None, None, "clash") for k in range(6)]
    rows += [(40, None, None, None, None), (41, "", None, None, None), (41, "a b c a b c a b c\n\nx\nx\n y", None, None, None), (None, "one\ttwo\x0bthree", None, None, None)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6)] + [(20, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], r["text"]): r for r in quality.quality(docs_of(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    tokens = lambda t: re.findall(r"\w+|[^\w\s]+", (t or "").lower())
    grams = lambda t: [spark_hash(w) % quality.BUCKETS for w in tokens(t)] + [spark_hash(a, b) % quality.BUCKETS for a, b in zip(tokens(t), tokens(t)[1:])]
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if i is not None and i < 6:
            target.update(grams(t))
    n, m, c = sum(raw.values()), sum(target.values()), quality.PRIOR

    def ratio(b):
        p = (raw[b] + c) / (n + c * quality.BUCKETS)
        return math.log((target[b] + c * quality.BUCKETS * p) / (m + c * quality.BUCKETS) / p)

    for i, t, *_ in rows:
        r, words = got[(i, t)], (t or "").encode().split()
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip(shared.BLANKS)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        g = grams(t)
        assert r["log_ratio"] == pytest.approx(sum(map(ratio, g)) / len(g) if g else 0.0, abs=1e-4)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and r["kept"] == (not r["base_failed"] and r["log_ratio"] >= quality.THRESHOLD)
    assert quality.quality(docs_of(spark, rows).limit(0), labels.limit(0)).count() == 0


# suffix tree


def scored(spark, train, ask, **how):
    rows = [(k, t, "train" if k < len(train) else None, None, None) for k, t in enumerate([*train, *ask])]
    got = {r["doc_id"]: r for r in suffixtree.score(docs_of(spark, rows), F.col("lang") == "train", **how).collect()}
    assert len(got) == len(rows)
    return [got[k] for k in range(len(rows))]


def test_base_scores(spark):
    train = ["a b c a b d" if k % 2 else "a b c" for k in range(40)] + [None]
    held = ["A b c zz", None, "zz " * 500, "", "x" * 100_000]
    for head in (2, 1000):  # counts from the head, and by the join
        c = Counter(w for t in train for w in [*suffixtree.tokens_of(t), None])
        n, v = sum(c.values()), len(c)
        for t, r in zip(train + held, scored(spark, train, held, head=head)):
            w = [*suffixtree.tokens_of(t), None]
            assert (r["train_tokens"], r["n_tokens"], r["n_known"]) == (n, len(w), sum(c[x] > 0 for x in w)) and r["score"] <= 0
            assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-6)
    rows = docs_of(spark, [(100, "a b", None, None, "clash"), (100, None, None, None, None), (None, "zz " * 500, None, None, None)])
    assert suffixtree.score(rows.limit(0), F.lit(True)).count() == 0
    assert suffixtree.score(rows, F.lit(False)).filter("score = 0 AND base_score = 0").count() == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the shared tables aren't here")
def test_made_up_words_score_below_held_out_text(spark):
    rng = np.random.default_rng(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    noise = [(10_000_000 + k, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(200)), None, None) for k in range(20)]
    every = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    kind = F.when(F.col("doc_id") >= 10_000_000, "noise").when(shared.crc_remainder(F.col("doc_id"), 7) == 2, "held").otherwise("train")
    got = suffixtree.score(every, (F.col("doc_id") < 10_000_000) & (shared.crc_remainder(F.col("doc_id"), 7) != 2)).withColumn("kind", kind)
    mean = {r["kind"]: r for r in got.groupBy("kind").agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).collect()}
    worst = got.filter("kind = 'noise'").agg(F.max(F.col("score") / F.col("n_tokens"))).first()[0]
    print({k: (round(r["score"], 3), round(r["base"], 3)) for k, r in mean.items()}, worst)
    assert worst < mean["held"]["score"] - 1 and mean["held"]["score"] < mean["train"]["score"]
    assert mean["held"]["score"] > mean["held"]["base"]


class PlainTree:
    """The same tree in plain Python: all contexts of up to depth symbols in dictionaries."""

    def __init__(self, train, depth, symbols):
        split = lambda t: [*suffixtree.tokens_of(t), None]
        self.words, self.depth = Counter(w for t in train for w in split(t)), depth
        once, twice = sum(c == 1 for w, c in self.words.items() if w), sum(c == 2 for w, c in self.words.items() if w)
        self.n, self.d = sum(self.words.values()), min(0.9, max(0.1, once / (once + 2 * twice) if once else 0.5))
        self.unseen = max(1, once * (once - 1) / (2 * (twice + 1)))
        self.top = set(sorted((w for w in self.words if w is not None), key=lambda w: (-self.words[w], w))[:symbols])
        self.follows, self.kept = {}, set()
        for t in train:
            path = ["^", *map(self.symbol, split(t))]
            for k in range(1, len(path)):
                for c in self.contexts(path, k):
                    self.follows.setdefault(c, Counter())[path[k]] += 1
        for size in range(1, depth + 1):
            for c, after in self.follows.items():
                total, gain = sum(after.values()), 0.0
                if len(c) == size and total > 1:
                    for w, k in after.items():
                        above = self.p(c[1:], w)
                        without = ((k - 1 - self.d) if k > 1 else 0.0) / (total - 1) + self.d * (len(after) - (k == 1)) / (total - 1) * above
                        gain += k * math.log(max(without, 1e-30) / above)
                    if gain >= suffixtree.DIVERGENCE:
                        self.kept.add(c)

    def symbol(self, w):
        return w if w is None or w in self.top else "?"

    def contexts(self, path, k):
        for size in range(1, self.depth + 1):
            if k < size or path[k - size] == "?":
                return
            yield tuple(path[k - size : k])

    def root(self, w):
        return (self.words[w] - self.d if self.words[w] else self.d * len(self.words) / self.unseen) / self.n

    def p(self, context, w):
        if not context:
            return self.root(w) if w != "?" else 1 - sum(self.root(x) for x in (*self.top, None))
        if context not in self.kept:
            return self.p(context[1:], w)
        after = self.follows[context]
        total = sum(after.values())
        return (after[w] - self.d if after[w] else 0.0) / total + self.d * len(after) / total * self.p(context[1:], w)

    def score(self, text):
        words = [*suffixtree.tokens_of(text), None]
        path, out = ["^", *map(self.symbol, words)], 0.0
        for k, w in enumerate(words, 1):
            longest = max(self.contexts(path, k), key=len, default=())
            out += math.log10(self.p(longest, path[k])) + (math.log10(self.root(w) / self.p((), "?")) if path[k] == "?" else 0.0)
        return out


@pytest.mark.parametrize("how", [{}, {"hot": 3}, {"hot": 40}, {"symbols": 9}, {"symbols": 4, "hot": 2, "head": 4}, {"depth": 2}, {"depth": 3, "hot": 3}])
def test_tree_score_equals_plain_python(spark, how, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(suffixtree, "HOT_SHARE", 0.0)
    sentences = ["a b c d e f g", "z b c d e f h", "x y x y x z", "q c d e f g", "u m n r", "v m n s"]
    train = [" ".join(f"{a} {b} {a}{b}" for a, b in zip(rng.choice(list("abcde"), 12), rng.choice(list("xyz"), 12))) for _ in range(40)]
    train += [" ".join(rng.choice(sentences, 4)) for _ in range(90)] + ["p q r"] * 3
    ask = ["p q r", "a x ax p q b", "x a q", "", "new words", "a b c d e f h", "z b c d e f g z b c d e f"]
    plain = PlainTree(train, how.get("depth", suffixtree.DEPTH), how.get("symbols", suffixtree.SYMBOLS))
    assert how or {len(c) for c in plain.kept} == {1, 2, 3, 4, 5}, "contexts of all lengths are kept"
    for t, r in zip(train + ask, scored(spark, train, ask, **how)):
        assert r["score"] == pytest.approx(plain.score(t), abs=1e-4), t


def test_states_are_distributions():
    plain = PlainTree(["a b c d e f g", "z b c d e f h", "u v"] * 9, 5, 6)
    for c in plain.kept:
        assert sum(plain.p(c, w) for w in (*plain.top, "?", None)) == pytest.approx(1)
    # the same of the tree at hand: what follows a kept context sums up to 1
    rng = np.random.default_rng(2)
    root = np.zeros(suffixtree.BASE)
    root[[0, 1, 2, suffixtree.OTHER, suffixtree.END]] = [0.4, 0.2, 0.1, 0.2, 0.1]
    code = rng.integers(0, 3, 4000) * suffixtree.BASE**4 + rng.integers(0, 3, 4000) * suffixtree.BASE**3 + sum(suffixtree.STOP * suffixtree.BASE**k for k in range(3))
    symbol = np.where(rng.random(4000) < 0.9, code // suffixtree.BASE**3 % suffixtree.BASE, suffixtree.END)
    tree = suffixtree.Tree(root, 0.5, 5)
    asked = np.array([0, 1, 2, suffixtree.OTHER, suffixtree.END])
    for one in np.unique(code):
        learned = np.r_[np.ones(4000), np.zeros(5)]
        got = suffixtree.grown(np.r_[code, np.full(5, one)], np.r_[symbol, asked], learned, tree)
        assert (10 ** got[-5:]).sum() == pytest.approx(1) and not np.allclose(10 ** got[-5:], root[asked])


def test_rare_contexts_of_a_large_corpus(spark):
    got = scored(spark, ["f g " * 100_000] * 10 + ["p q r"] * 3, [])
    assert got[-1]["score"] > -8  # p by itself has about -5.8, q and r follow; the root alone gives less than -17


class AnyWordTree(PlainTree):
    """Contexts of any words; next symbols are the most frequent words, the end and all others."""

    def __init__(self, train, depth, symbols):
        super().__init__(train, 0, symbols)
        self.depth = depth
        for path in (["^", *suffixtree.tokens_of(t), None] for t in train):
            for k in range(1, len(path)):
                for c in self.contexts(path, k):
                    self.follows.setdefault(c, Counter())[self.symbol(path[k])] += 1
        for c, after in sorted(self.follows.items(), key=lambda x: len(x[0])):
            total, gain = sum(after.values()), 0.0
            for w, k in after.items() if total > 1 else ():
                above = self.p(c[1:], w)
                without = ((k - 1 - self.d) if k > 1 else 0.0) / (total - 1) + self.d * (len(after) - (k == 1)) / (total - 1) * above
                gain += k * math.log(max(without, 1e-30) / above)
            if gain >= suffixtree.DIVERGENCE:
                self.kept.add(c)

    def contexts(self, path, k):
        return (tuple(path[k - size : k]) for size in range(1, min(k, self.depth) + 1))

    def score(self, text):
        path, out = ["^", *suffixtree.tokens_of(text), None], 0.0
        for k in range(1, len(path)):
            s = self.symbol(path[k])
            longest = max(self.contexts(path, k), key=len, default=())
            out += math.log10(self.p(longest, s)) + (math.log10(self.root(path[k]) / self.p((), "?")) if s == "?" else 0.0)
        return out


@pytest.mark.parametrize("how", [{"common": 4}, {"common": 4, "head": 4}, {"common": 9, "head": 12, "hot": 3}, {"common": 4, "hot": 2, "depth": 3}, {}])
def test_contexts_are_of_any_words(spark, how, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(suffixtree, "HOT_SHARE", 0.0)
    sentences = ["a b c d e f g", "z b c d e f h", "x y x y x z", "q c d e f g", "u m n r a", "v m n s b"]
    train = [" ".join(f"{a} {b} {a}{b}" for a, b in zip(rng.choice(list("abcde"), 12), rng.choice(list("xyz"), 12))) for _ in range(40)]
    train += [" ".join(rng.choice(sentences, 4)) for _ in range(90)] + ["p q r a"] * 3 + ["once a b"]
    ask = ["p q r a", "a x ax p q b", "x a q", "", "new words a", "a b c d e f h", "z b c d e f g z b c d e f", "u m n r a v m n s b", "once a b"]
    plain = AnyWordTree(train, how.get("depth", suffixtree.DEPTH), min(how.get("common", suffixtree.SYMBOLS), how.get("head", suffixtree.HEAD)))
    assert not how or {len(c) for c in plain.kept if any(plain.symbol(w) == "?" for w in c if w != "^")} >= {1, 2, 3}
    for t, r in zip(train + ask, scored(spark, train, ask, **how)):
        assert r["score"] == pytest.approx(plain.score(t), abs=1e-4), t


def test_words_beyond_the_symbols_are_contexts(spark):
    common = [f"w{k}" for k in range(suffixtree.SYMBOLS)]
    rng = np.random.default_rng(7)
    train = [" ".join(rng.permutation(common)) for _ in range(6)] + [f"z{k} w{k}" for k in range(50) for _ in range(3)]
    follows, other = scored(spark, train, ["z7 w7", "z7 w8"])[-2:]
    assert follows["score"] > other["score"] + 2  # the root alone gives both words about 1.5e-4


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def test_shuffles_are_gone_when_scores_are_asked_for(spark):
    before = shuffle_files(spark)
    found = suffixtree.score(docs_of(spark, [(k, f"a b w{k} c d", None, None, None) for k in range(50)]), F.lit(True))
    until = time.time() + 10  # they are deleted in the background
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and found.count() == 50
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_each_token_is_in_one_share(spark, monkeypatch):
    train, got = ["a b c d x y", "y x w0 b c d", "q r s"] * 30, []
    for shares in (1, 3, 50):  # some of 50 have no token
        monkeypatch.setattr(suffixtree, "SHARES", shares)
        got.append([r["score"] for r in scored(spark, train, ["a b c d x y", "", "q r new", None], common=3)])
    assert got[1] == pytest.approx(got[0], abs=1e-4) and got[2] == pytest.approx(got[0], abs=1e-4)
    words = np.arange(60_000, dtype=np.uint64)
    assert np.bincount(suffixtree.share_of(words, 3).astype(int)).min() > 19_000


# top-k


def test_exact_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)] + [(1000 + k, [0.5] * 8) for k in range(50)]
    vectors += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (420, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    got = vafile.exact_top_k(frame, F.col("vec_id") % 20 == 0, 7, candidates=64, queries=8).collect()
    fine = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, x in fine.items():
        if q % 20 == 0:
            scored = sorted((-int(x @ y), i) for i, y in fine.items() if i != q and len(x) == len(y))[:7]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert vafile.exact_top_k(frame.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


@pytest.mark.parametrize("scale", [64.0, 20_000.0])
def test_bounds_hold(scale):
    rng = np.random.default_rng(4)
    v = np.floor(scale * rng.normal(size=(500, 24)))
    low = v.min(axis=0)
    width = np.ceil((v.max(axis=0) - low + 1) / vafile.CELLS)
    cells = np.floor((v - low) / width).astype(np.uint8)
    exact, seen = v[:40] @ v.T, np.zeros((40, 500), bool)
    for i, j, lower, upper in vafile.scan(np.arange(40), v[:40], np.arange(500), cells, low, width, 5):
        assert (lower <= exact[i, j]).all() and (exact[i, j] <= upper).all()
        seen[i, j] = True
    for i in range(40):
        best = [j for j in np.argsort(-exact[i], kind="stable") if j != i][:5]
        assert seen[i, best].all()
    assert seen.sum() < 40 * 100


def test_top_k_of_repeated_ids_and_large_numbers(spark):
    rows = [(20, [2.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [4.0, 1.0]), (2, [-1.0, 0.0]), (40, [1e15, 1.0]), (3, [])]
    got = vafile.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3, scale=1.0).collect()
    by = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (20, 40)}
    assert by[20] == [(1, 40, 10**15), (2, 1, 5), (3, 1, 4)]
    assert by[40] == [(1, 1, 5 * 10**15), (2, 1, 4 * 10**15 + 1), (3, 20, 2 * 10**15)]


# licenses


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit-notice"]
    rows = [(1, "İ x. " + mit.upper() + " tail", None, None, None), (2, "Released under the MIT license!", None, None, None), (3, None, None, None, None), (4, "the of and " * 5000, None, None, None), (2, "", None, None, None),
            (5, "a " * 3000 + mit.replace("without restriction", "wholly without any restriction"), None, None, None)]
    got = licenses.scan(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "mit-notice"), (2, "mit-line"), (5, "mit-notice")]
    one = next(r for r in got if r["doc_id"] == 1)
    assert rows[0][1][one["span_start"] : one["span_end"]].startswith("PERMISSION IS") and one["coverage"] == 1.0
    assert licenses.scan(docs_of(spark, rows).limit(0)).count() == 0 and licenses.scan(docs_of(spark, rows), {}).count() == 0
    assert licenses.winnow([5, 3, 3, 9], 2) == [1, 2]


def test_license_with_insertions_and_even_edits(spark):
    mit = licenses.TEMPLATES["mit-notice"].split()
    inserted = " ".join(mit[:43] + [f"page{k}" for k in range(12)] + mit[43:])
    removed = " ".join(mit[:30] + mit[42:])
    even, k = [], 0
    while k < len(mit):  # two or three words stay, one is another
        n = 2 + (len(even) % 2)
        even, k = [*even, *mit[k : k + n], "zz"], k + n + 1
    twice = " ".join(mit) + " w" * 20 + " " + " ".join(mit)
    apart = " ".join(mit[:43]) + " w" * 500 + " " + " ".join(mit[43:])
    rows = [(k, "w " * 50 + t + " w" * 50, None, None, None) for k, t in enumerate((inserted, removed, " ".join(even), twice, apart))]
    got = licenses.scan(docs_of(spark, rows), window=1).orderBy("doc_id", "span_start").collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(k, "mit-notice") for k in (0, 1, 2, 3, 3)]
    size = len(licenses.TOKEN.findall(" ".join(mit).lower()))
    assert [r["matched_words"] for r in got if r["doc_id"] != 2] == [size, size - 12, size, size]
    for r in got:  # against the longest common subsequence of the span
        words = licenses.TOKEN.findall(rows[r["doc_id"]][1][r["span_start"] : r["span_end"]].lower())
        assert r["matched_words"] == licenses.common(licenses.TOKEN.findall(" ".join(mit).lower()), words)


# WARC


def test_salvage():
    bodies = [b"a" * 100, b"WARC/1.1 inside", b"", b"z"]
    records = [warc.record(k, "http://x/ y", b, warc.digest(b), None, False) for k, b in enumerate(bodies)]
    for pack in (warc.member, lambda r: r):
        data = b"".join(map(pack, records))
        assert [x[0] for x in warc.salvage(warc.stored_bytes(data))] == ["record"] * 4
        second = len(pack(records[0]))
        broken = data[: second + 30] + b"\x00\xff" + data[second + 32 :]
        found = list(warc.salvage(warc.stored_bytes(b"junk" + broken + pack(records[0])[:40])))
        assert [x[0] for x in found if x[0] == "gap"].count("gap") == 3
        assert [x[3]["warc-page-id"] for x in found if x[0] == "record"] == ["0", "2", "3"]
        spans = sorted((x[1], x[2]) for x in found)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_warc_round_trip(spark):
    rows = [(3, "u", "same", 1), (1, None, "same", 1), (2, "u", None, 1), (4, "u", "", 1), (None, "u", "same", 1), (1, "u", "same", 1), (9, "u", "é\r\n\r\n" * 4000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first int")
    manifest = warc.write_warc(pages, shared.scratch(spark, "test-warc"))
    got = warc.read_warc(manifest).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [("1", "response", None), ("1", "revisit", 1), ("2", "response", None), ("3", "revisit", 1), ("4", "revisit", 2), ("9", "response", None), ("None", "revisit", 1)]
    for r in got:
        assert r["payload_digest"] in {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h, _ in rows}
    assert warc.read_warc(warc.write_warc(pages.limit(0), shared.scratch(spark, "test-warc"))).count() == 0
    few = warc.read_warc(warc.write_warc(pages, shared.scratch(spark, "test-warc"), least=5)).filter("record_type = 'revisit'").count()
    assert few == 0


def test_generated_pages_equal_a_plan_in_plain_python(spark):
    rng = np.random.default_rng(8)
    bodies = [None, "", "x", "same body", "é" * 3000, "\x00\r\n\r\nWARC/1.1"] + [f"page {k}" * k for k in range(20)]
    rows = [(None if k % 29 == 0 else int(rng.integers(60)), [None, "u", "v"][k % 3], bodies[int(rng.integers(len(bodies)))]) for k in range(400)]
    # rows come out of a shuffle, in any order
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for least in (0, 5):
        got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(warc.write_warc(pages, shared.scratch(spark, "test-warc"), least=least)).collect())
        want, seen = Counter(), {}
        for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            body = (h or "").encode()
            again = len(body) >= least and body in seen
            want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", seen[body] if again else None)] += 1
            seen.setdefault(body, i)
        assert got == want


def test_salvage_reads_each_member_once():
    record = warc.record(1, "u", os.urandom(60_000), "x", None, False)
    data = warc.member(record) * 40
    read = []

    class Counted:  # bytes handed to the decompressor
        def __init__(self, wbits):
            self.z = zlib.decompressobj(wbits)

        def decompress(self, part):
            read.append(len(part))
            return self.z.decompress(part)

        def __getattr__(self, name):
            return getattr(self.z, name)

    class Zlib:
        decompressobj, error = Counted, zlib.error

    plain, warc.zlib = warc.zlib, Zlib
    try:
        assert sum(x[0] == "record" for x in warc.salvage(warc.stored_bytes(data))) == 40
    finally:
        warc.zlib = plain
    assert sum(read) < 3 * len(data)


# mixing


@pytest.mark.parametrize("bound", [100, 0])
def test_mixing(spark, bound):
    rows = [(k, "w " * (k % 5), None, ["b", "a", None, "c"][k % 4], "clash") for k in range(200)] + [(None, None, None, "empty", None), (3, "w w", None, "a", None)]
    got = mixing.mix_plan(docs_of(spark, rows), bound=bound).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len((t or "").split())
    total = 1.5 * sum(size.values())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), total
    open_ = set(order)
    while left > 1e-9 and open_:
        w, give = sum(weight[s] for s in open_), left
        for s in list(open_):
            target[s] += give * weight[s] / w
        left = sum(max(0.0, target[s] - 2 * size[s]) for s in order)
        for s in order:
            if target[s] >= 2 * size[s]:
                target[s] = 2.0 * size[s]
                open_.discard(s)
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and r["_copies"] <= 2
    out = mixing.mix(docs_of(spark, rows), bound=bound)
    assert out.columns == ["doc_id", "text", "lang", "source", "kept"] and out.count() == sum(r["_copies"] for r in got)
    assert mixing.mix(docs_of(spark, rows).limit(0), bound=bound).count() == 0
