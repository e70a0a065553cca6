"""The toxicity classifier: scores against a plain sum, what it may learn from, accuracy on held-out rows."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookback.llm import shared, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA, LABELS = "doc_id long, text string, lang string, score string", "doc_id long, quality int, toxic int"
RUDE, CALM = ["sludgehead", "vermin!", "Dröhnkopf"], ["garden", "water", "straße", "evening", "paper", "cloud", "table", "morning"]


def corpus(n: int = 240) -> tuple[list, list]:
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        words = rng.choices(CALM, k=rng.randint(5, 60)) + ([rng.choice(RUDE)] if toxic else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words), "en", "x"))
        labels.append((k, 1, int(toxic)))
    odd = [(None, "garden vermin!", None, None), (700, None, None, None), (701, "", None, None), (702, "ab", "", ""), (3, "paper cloud", "en", "other"), (703, "\x00\x00\x00\x00 Ünïcode 漢字", "en", "")]
    return docs + odd + [docs[8]] * 3, labels + [(None, 1, 1), (5, 0, None), (6, 0, 7), (9999, 1, 1), (8, 1, 0)]


def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)


def plain_score(text, model) -> float:
    raw = (text or "").lower().encode()
    gain = dict(zip(model.buckets.tolist(), model.gain.tolist()))
    seen = set()
    for n in toxicity.LENGTHS:
        for i in range(len(raw) - n + 1):
            code = int.from_bytes(raw[i : i + n], "big")
            seen.add(((code * 8 + n) * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - toxicity.BITS))
    return 1 / (1 + math.exp(-(model.bias + sum(gain.get(b, 0.0) for b in seen))))


def test_scores_equal_a_plain_sum(spark):
    docs, labels = tables(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.predict(docs, model).collect()
    assert len(rows) == docs.count() and rows[0].__fields__ == ["doc_id", "text", "lang", "score", "predicted"]
    for r in rows:
        assert r["score"] == pytest.approx(plain_score(r["text"], model), abs=1e-5)
        assert r["predicted"] == int(r["score"] >= 0.5)
        assert r["predicted"] == int(any(w.lower() in (r["text"] or "").lower() for w in RUDE))


def test_log_count_ratios_equal_counts(spark):
    docs, labels = tables(spark)
    rows = toxicity.sample(docs, labels).select("toxic", "text").collect()
    found = {r["bucket"]: r["ratio"] for r in toxicity.log_count_ratios(toxicity.n_grams(toxicity.sample(docs, labels))).collect()}
    n1, n0 = sum(r["toxic"] for r in rows), sum(1 - r["toxic"] for r in rows)
    counts: dict[int, list[int]] = {}
    for r in rows:
        for b in set(toxicity.buckets_of(r["text"].lower().encode()).tolist()):
            counts.setdefault(b, [0, 0])[r["toxic"]] += 1
    assert found
    for b, ratio in found.items():
        zero, one = counts[b]
        assert ratio == pytest.approx(math.log((one + 1) / (n1 + 2)) - math.log((zero + 1) / (n0 + 2)))


def test_a_long_text_is_read_whole_and_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("abc dé", k=5_000)) + " vermin!"
    whole = toxicity.distinct_buckets(text)
    monkeypatch.setattr(toxicity, "PIECE", 64)
    assert len(list(toxicity.pieces(text))) > 50
    assert np.array_equal(whole, toxicity.distinct_buckets(text))
    for short in ("", "a", "ab", "abc", "abcdé"):
        assert list(toxicity.pieces(short)) == [short.lower().encode()]


def test_empty_tables(spark):
    docs, labels = tables(spark)
    none, unlabelled = docs.limit(0), labels.limit(0)
    assert toxicity.predict(none, toxicity.fit(none, labels)).collect() == []
    assert {r["predicted"] for r in toxicity.predict(docs, toxicity.fit(docs, unlabelled)).collect()} == {0}
    one_class = toxicity.predict(docs, toxicity.fit(docs, labels.filter("toxic = 0"))).agg(F.max("predicted"), F.max("score")).first()
    assert one_class[0] == 0 and one_class[1] < 0.1


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")
def test_accuracy_on_held_out_rows_and_what_is_learned(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.op11_toxicity(spark, SF).toPandas().set_index("doc_id")
    assert got.held_out.equals(got.index.to_series().map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).rename("held_out"))
    for held in (True, False):
        known = labels.filter("toxic IS NOT NULL").toPandas().set_index("doc_id").toxic
        known = known[got.held_out.reindex(known.index) == held]
        assert (got.predicted.reindex(known.index) == known).mean() > 0.95
    # labels of held-out rows are turned about: nothing changes
    held = shared.crc_remainder(F.col("doc_id"), 5) == 0
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).write.parquet(str(tmp_path / "documents.parquet"))
    again = toxicity.op11_toxicity(spark, str(tmp_path)).toPandas().set_index("doc_id")
    assert again.sort_index().equals(got.sort_index())
