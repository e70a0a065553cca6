"""Toxicity (operator 11): a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Lengths of n-grams in bytes of the lower-cased text, and buckets that they are hashed to.
LENGTHS, BITS = (3, 4, 5), 22
#: Labelled rows of each class that the classifier is fitted on (by a hash of doc_id): the bound of the sample.
PER_CLASS = 2_000
#: An n-gram is a feature if the likelihood ratio (2 log) of its counts in the two classes against one rate for both is so
#: high, which of some millions of n-grams hardly one reaches by chance; of these at most so many of the clearest.
CLEAR, FEATURES = 30.0, 1 << 14
SMOOTH, PENALTY, STEPS = 1.0, 1.0, 300
#: The bias where nothing was learned.
NOTHING = -30.0
#: Bytes of a text that are hashed at once; the next piece begins with the last bytes of the one before.
PIECE = 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets_of(raw: bytes) -> np.ndarray:
    """The buckets of all n-grams of a piece of a text."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out, code = [], b
    for n in range(2, max(LENGTHS) + 1):
        code = (code[:-1] << np.uint64(8)) | b[n - 1 :]
        if n in LENGTHS:
            out.append((code * np.uint64(8) + np.uint64(n)) * _MIX >> np.uint64(64 - BITS))
        if len(code) < 1:
            break
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def pieces(text: str):
    """A lower-cased text's bytes in pieces that overlap so that every n-gram lies in one of them."""
    raw = text.lower().encode("utf-8", "surrogatepass")
    step = PIECE - max(LENGTHS) + 1
    for a in range(0, max(len(raw) - max(LENGTHS) + 1, 1), step):
        yield raw[a : a + PIECE]


def distinct_buckets(text: str) -> np.ndarray:
    found = np.zeros(0, np.int64)
    for raw in pieces(text):
        found = np.union1d(found, buckets_of(raw))
    return found


@dataclass
class Model:
    buckets: np.ndarray  # of features, ascending
    gain: np.ndarray  # what a feature's presence adds: its log-count ratio times its weight
    bias: float


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, toxic, text, weight: written labelled rows, about per_class of each class; weight is what each stands for.

    A doc_id whose labels differ counts as toxic. Which rows are read follows from a hash of doc_id and a rate from the
    class's count.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = shared.materialize(known, "toxic-labels")
    rate = known.groupBy("toxic").agg(F.least(F.lit(1.0), F.lit(float(per_class)) / F.count("*")).alias("rate"))
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    ids = shared.materialize(known.join(F.broadcast(rate), "toxic").filter(chance < F.col("rate")).select("doc_id", "toxic", (1 / F.col("rate")).alias("weight")), "sampled-ids")
    # about 2 * per_class ids are broadcast; copies of a row say nothing more
    return shared.materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"]), "toxicity-sample")


def n_grams(rows: DataFrame) -> DataFrame:
    """doc, toxic, weight, found (distinct buckets) of each sampled row, written."""

    def run(batches):
        for batch in (step for whole in batches for step in shared.row_steps(whole, 50)):
            found = [distinct_buckets(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["doc", "toxic", "weight", "found"])

    rows = rows.select(F.xxhash64("doc_id", "text").alias("doc"), "toxic", "weight", "text")
    return shared.materialize(rows.mapInArrow(run, "doc long, toxic int, weight double, found array<int>"), "toxicity-ngrams")


def log_count_ratios(grams: DataFrame, features: int = FEATURES) -> DataFrame:
    """bucket, ratio of the chosen features: log of a bucket's share of toxic documents against its share of others.

    Shares are of rows weighted by what they stand for within their class; SMOOTH is added to both counts.
    """
    sums = {r["toxic"]: r["n"] for r in grams.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(sums.get(1, 0)), float(sums.get(0, 0))
    one, zero = F.col("one"), F.col("zero")
    counts = grams.select("toxic", F.explode("found").alias("bucket")).groupBy("bucket").agg(F.sum("toxic").alias("one"), F.count("*").alias("n")).withColumn("zero", F.col("n") - F.col("one"))
    ratio = F.log((one + SMOOTH) / (n1 + 2 * SMOOTH)) - F.log((zero + SMOOTH) / (n0 + 2 * SMOOTH))
    part = lambda seen, of, rate: F.when(seen > 0, seen * F.log(seen / (of * rate))).otherwise(F.lit(0.0))
    rate = F.col("n") / (n1 + n0)
    clear = 2 * (part(one, n1, rate) + part(n1 - one, n1, 1 - rate) + part(zero, n0, rate) + part(n0 - zero, n0, 1 - rate))
    clear = counts.select("bucket", ratio.alias("ratio"), clear.alias("clear")).filter(F.col("clear") >= CLEAR)
    return clear.orderBy(F.desc("clear"), "bucket").limit(features).select("bucket", "ratio")


def fit_weights(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features, and a bias, by logistic loss with a quadratic penalty; accelerated gradient steps."""
    size = np.array([len(r) for r in rows])
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    scaled = ratio[flat]
    total = weight.sum()
    # a bound of the curvature: the largest row and column sums of the features' squares
    row = np.bincount(doc, np.abs(scaled), len(rows)) + 1
    column = np.bincount(flat, np.abs(scaled) * (weight * 1.0)[doc], len(ratio))
    step = 4 / (max(row.max() * max(column.max(initial=0.0), total) / total, 1e-9) + PENALTY / total)
    w, b = np.zeros(len(ratio)), float(np.log((weight[toxic == 1].sum() + 1) / (weight[toxic == 0].sum() + 1)))
    look, look_b, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        z = np.clip(np.bincount(doc, scaled * look[flat], len(rows)) + look_b, -30, 30)
        error = (1 / (1 + np.exp(-z)) - toxic) * weight / total
        new = look - step * (np.bincount(flat, scaled * error[doc], len(ratio)) + PENALTY * look / total)
        new_b = look_b - step * error.sum()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """A classifier of the labelled rows; without rows of both classes it knows only how common toxic ones are, and without any calls none toxic.

    The driver gets the features' ratios and the sample's features: at most `features` numbers a row of about 2 * per_class.
    """
    grams = n_grams(sample(docs, labels, per_class))
    chosen = log_count_ratios(grams, features).toArrow().sort_by("bucket")
    buckets, ratio = chosen.column("bucket").to_numpy().astype(np.int64), chosen.column("ratio").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(buckets)

    def run(batches):
        for batch in batches:
            kept = [np.flatnonzero(np.isin(sent.value, r.values.to_numpy(), assume_unique=True)) for r in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.list_(pa.int32()))], names=["doc", "toxic", "weight", "found"])

    rows = grams.mapInArrow(run, "doc long, toxic int, weight double, found array<int>").orderBy("doc").toArrow()
    toxic, weight = rows.column("toxic").to_numpy(), rows.column("weight").to_numpy()
    if not len(rows):
        return Model(buckets, np.zeros(len(buckets)), NOTHING)
    w, b = fit_weights([r.values.to_numpy().astype(np.int64) for r in rows.column("found")], toxic, weight, ratio)
    return Model(buckets, w * ratio, b)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score and predicted to every row: how likely it is toxic, from which n-grams its whole text has.

    How often it has them doesn't matter. Null and empty texts get the score of no n-gram. A very long text is read in
    pieces, across which an n-gram still counts once. Rows that repeat a doc_id, or have none, are scored each by its text;
    an empty table gives an empty one. Other columns pass through, but for those of the two names, which are replaced.
    """
    sent, own = docs.sparkSession.sparkContext.broadcast(model), f"gains {uuid.uuid4().hex}"
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    place = names.index("text")
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    def table() -> np.ndarray:
        gain = np.zeros(1 << BITS, np.float32)
        gain[sent.value.buckets] = sent.value.gain
        return gain

    def score(text: str, gain: np.ndarray) -> float:
        hits = [h[gain[h] != 0] for h in map(buckets_of, pieces(text))]
        z = sent.value.bias + float(gain[np.unique(np.concatenate(hits))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def run(batches):
        gain = shared.kept(own, table)
        for batch in (step for whole in batches for step in shared.row_steps(whole)):
            found = [score(t.as_py() or "", gain) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=[*names, "score", "predicted"])

    return docs.select(*names).mapInArrow(run, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (shared.table(spark, sf_dir, t) for t in ("documents", "labels"))
    learned = lambda t: t.filter(shared.crc_remainder(F.col("doc_id"), 5) != 0)
    found = predict(docs.select("doc_id", "text"), fit(learned(docs), learned(labels)))
    return found.select("doc_id", (shared.crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
