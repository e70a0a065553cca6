"""Language identification by a linear-chain conditional random field over words (operator 1)."""

from __future__ import annotations

import pickle
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Documents of each language that training reads (picked by a hash of doc_id): the only bound of the sample.
DOCS_PER_LANGUAGE = 250
#: Hashed features, words of a language's lexicon, words of a sequence, and bytes of the longest word: a longer run of
#: letters, as in scripts without spaces, is several words.
BUCKETS, LEXICON, SEQUENCE, WIDTH = 1 << 16, 4_000, 128, 26
EPOCHS, BATCH, RATE, DECAY = 4, 32, 0.2, 1e-4
#: Different words whose scores a worker keeps. Speed only.
KEEP = 200_000

# \w takes numbers such as \u00b2 or \u2167 for word characters too: letters are those of category L.
_WORD_CHARACTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    runs = _WORD_CHARACTERS.findall(text)
    if not runs or "".join(runs).isalpha():
        return runs
    return "".join(c if c.isalpha() else " " for c in text).split(" ")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(run: str) -> list[str]:
    """A run of letters as words of at most WIDTH bytes."""
    out, start, size = [], 0, 0
    for i, c in enumerate(run):
        n = len(c.encode())
        if size + n > WIDTH:
            out.append(run[start:i])
            start, size = i, 0
        size += n
    return [*out, run[start:]]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, long ones in pieces: every letter is in one of the words."""
    low = text.lower()
    runs, short = [r for r in letter_runs(low) if r], WIDTH if low.isascii() else WIDTH // 4
    if len(max(runs, key=len, default="")) <= short:
        return runs
    return [w for r in runs for w in ([r] if len(r) <= short else pieces(r))]


def bucket(kind: int, code: np.ndarray) -> np.ndarray:
    h = (code.astype(np.uint64) * np.uint64(64) + np.uint64(kind)) * _MIX
    return (h >> np.uint64(48)).astype(np.int64) % BUCKETS


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word (of at most WIDTH bytes), with 0/1 where a feature is present: affixes, byte n-grams, lexicon entry."""
    raw, width = [w.encode() for w in words], WIDTH
    size = np.array([len(b) for b in raw])
    m = np.zeros((len(raw), width + 2), np.uint64)
    m[:, 1:-1] = np.array(raw, dtype=f"S{width}").view(np.uint8).reshape(len(raw), width)
    m[:, 0] = 1
    rows = np.arange(len(raw))
    m[rows, size + 1] = 2
    found, there = [], []

    def add(kind, code, present):
        found.append(bucket(kind, code))
        there.append(present)

    for n in (2, 3, 4):
        code = np.zeros((len(raw), width + 3 - n), np.uint64)
        for k in range(n):
            code = code * np.uint64(256) + m[:, k : k + code.shape[1]]
        present = np.arange(code.shape[1])[None, :] + n <= size[:, None] + 2
        for j in range(code.shape[1]):
            add(n, code[:, j], present[:, j])
    for n in (1, 2, 3, 4):
        prefix, suffix = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
        for k in range(n):
            prefix = prefix * np.uint64(256) + m[:, k + 1]
            suffix = suffix * np.uint64(256) + m[rows, np.maximum(size + 1 - n + k, 0)]
        add(8 + n, prefix, size >= n)
        add(16 + n, suffix, size >= n)
    known = np.array([lexicon.get(w, -1) for w in words])
    found.append(np.where(known >= 0, BUCKETS + known, 0))
    there.append(known >= 0)
    return np.stack(found, axis=1), np.stack(there, axis=1).astype(np.float32)


def posteriors(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences that lie one behind the other in scores (words x labels).

    Gives each word's label probabilities, and the expected number of moves between labels over all sequences.
    """
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t, s = np.exp(move), np.exp(start)
    forward, backward, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
    alive = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]) if len(size) else 0)]  # sequences longer than k
    for k, n in enumerate(alive):
        at = begin[:n] + k
        f = e[at] * (s if k == 0 else forward[at - 1] @ t)
        scale[at] = f.sum(axis=1)
        forward[at] = f / scale[at][:, None]
    moves = np.zeros_like(move)
    for k in range(len(alive) - 1, 0, -1):
        at = begin[: alive[k]] + k
        ahead = e[at] * backward[at] / scale[at][:, None]
        backward[at - 1] = ahead @ t.T
        moves += t * (forward[at - 1].T @ ahead)
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True), moves


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature x label
    start: np.ndarray
    move: np.ndarray
    lexicon: dict[str, int]

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), np.float32)
        for a in range(0, len(words), 4_096):
            found, there = features(words[a : a + 4_096], self.lexicon)
            total = np.zeros((len(found), len(self.languages)), np.float32)
            for j in range(found.shape[1]):
                if there[:, j].any():
                    total += self.weights[found[:, j]] * there[:, j, None]
            out[a : a + 4_096] = total
        return out


def lexicon_of(texts: list[list[str]], labels: list[int], n: int) -> dict[str, int]:
    """The LEXICON most frequent words of each language, numbered."""
    counts: list[dict[str, int]] = [{} for _ in range(n)]
    for words, label in zip(texts, labels):
        for w in words:
            counts[label][w] = counts[label].get(w, 0) + 1
    chosen = sorted({w for c in counts for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON] if c[w] > 1})
    return {w: k for k, w in enumerate(chosen)}


def train(rows: list[tuple[str, str]], seed: int = 1) -> Model:
    """Fits the field by its conditional likelihood on (text, language) rows.

    A document's words carry its language. Half of the training sequences switch between documents of different
    languages every 4 to 40 words, so that moves between languages are learned too.
    """
    languages = sorted({lang for _, lang in rows})
    texts = [words_of(t) for t, _ in rows]
    labels = [languages.index(lang) for _, lang in rows]
    n, rng = len(languages), np.random.default_rng(seed)
    lexicon = lexicon_of(texts, labels, n)
    runs = [(w[a : a + SEQUENCE], y) for w, y in zip(texts, labels) for a in range(0, len(w), SEQUENCE)]
    sequences: list[tuple[list[str], list[int]]] = [(w, [y] * len(w)) for w, y in runs]
    by_label = [[w for w, y in runs if y == k] for k in range(n)]
    for _ in range(len(runs) if n > 1 else 0):
        words, path = [], []
        while len(words) < SEQUENCE:
            y = int(rng.integers(n))
            run = by_label[y][int(rng.integers(len(by_label[y])))] if by_label[y] else []
            size = int(rng.integers(4, 41))
            a = int(rng.integers(max(1, len(run) - size + 1)))
            words += run[a : a + size]
            path += [y] * len(run[a : a + size])
        sequences.append((words[:SEQUENCE], path[:SEQUENCE]))
    vocabulary = sorted({w for words, _ in sequences for w in words})
    number = {w: k for k, w in enumerate(vocabulary)}
    parts = [features(vocabulary[a : a + 4_096], lexicon) for a in range(0, len(vocabulary), 4_096)]
    found = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 1), np.int64)
    there = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, 1), np.float32)
    size = BUCKETS + len(lexicon)
    weights, start, move = np.zeros((size, n), np.float32), np.zeros(n), np.zeros((n, n))
    squares = [np.full_like(weights, 1e-6), np.full_like(start, 1e-6), np.full_like(move, 1e-6)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(sequences))
        for a in range(0, len(order), BATCH):
            batch = [sequences[i] for i in order[a : a + BATCH]]
            lengths = np.array([len(w) for w, _ in batch])
            ids = np.array([number[w] for words, _ in batch for w in words])
            gold = np.array([y for _, path in batch for y in path])
            f, h = found[ids], there[ids]
            scores = np.zeros((len(ids), n))
            for k in range(n):
                scores[:, k] = (weights[:, k][f] * h).sum(axis=1)
            p, moves = posteriors(scores, lengths, start, move)
            error = p.copy()
            error[np.arange(len(gold)), gold] -= 1
            first = np.cumsum(lengths) - lengths
            inner = np.setdiff1d(np.arange(len(gold)), first)
            np.subtract.at(moves, (gold[inner - 1], gold[inner]), 1)
            flat, present = f.ravel(), h.ravel()
            grad = np.stack([np.bincount(flat, (error[:, k, None] * h).ravel() * (present > 0), size) for k in range(n)], axis=1)
            for value, g, s in ((weights, grad + DECAY * weights, squares[0]), (start, error[first].sum(axis=0), squares[1]), (move, moves, squares[2])):
                s += g * g
                value -= RATE * g / np.sqrt(s)
    return Model(languages, weights, start, move, lexicon)


def picked(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """doc_id, text and lang of about per_language labelled documents of each language.

    Whole texts with a letter; documents are picked by a hash of doc_id and text at a rate that follows from the
    language's count, so that their number is binomial with mean per_language at most.
    """
    fit = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = shared.materialize(fit.groupBy("lang").count(), "languages")
    chance = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1 << 40)) / float(1 << 40)
    rated = fit.select("doc_id", "text", "lang").join(F.broadcast(counts), "lang")  # one row a language
    return rated.filter(chance < F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count"))).select("doc_id", "text", "lang")


def in_order(rows: list[dict]) -> list[tuple[str, str]]:
    rows = sorted(rows, key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return [(r["text"], r["lang"]) for r in rows]


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of what picked() gives, always in the same order."""
    return in_order([r.asDict() for r in picked(docs, per_language).collect()])


class Scored(dict):
    """Word to its row in a growing table of scores."""

    def __init__(self, model: Model) -> None:
        self.model, self.table, self.missing = model, np.zeros((0, len(model.languages)), np.float32), []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.table) + len(self.missing)
        self.missing.append(word)
        return k

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > KEEP:
            self.clear()
            self.table = self.table[:0]
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.missing:
            self.table = np.concatenate([self.table, self.model.scores(self.missing)])
            self.missing = []
        return self.table[ids]


def segments(lengths: np.ndarray) -> np.ndarray:
    """A document's words are labelled in sequences of at most SEQUENCE words, one behind the other."""
    full, last = lengths // SEQUENCE, lengths % SEQUENCE
    n = full + (last > 0)
    out = np.full(int(n.sum()), SEQUENCE)
    ends = np.cumsum(n)[(n > 0) & (last > 0)] - 1
    out[ends] = last[last > 0]
    return out


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds lang_pred and score, or columns of other names: the language with most of the words' probability, and its share of it.

    A text that is null or has no letter is `und` with score 0; so is every text where nothing was learned. All other
    columns pass through, but for those of the names of the two, which are replaced. Every word of a text counts, and every
    letter of a word. Rows that repeat a doc_id, or have none, are read each by its text. An empty table gives an empty one.
    """
    sent, own = docs.sparkSession.sparkContext.broadcast(model), f"scores {uuid.uuid4().hex}"
    names = [c for c in docs.columns if c not in (lang, score)]
    place = names.index("text")
    schema = docs.select(*names).schema.add(lang, "string").add(score, "double")

    def run(batches):
        m = sent.value
        scored = shared.kept(own, lambda: Scored(m))
        for batch in (step for whole in batches for step in shared.row_steps(whole)):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in shared.slices(texts, 250_000):
                found = [words_of(t) if m.languages else [] for t in texts[a:b]]
                lengths = np.array([len(w) for w in found], np.int64)
                best_lang, best_score = ["und"] * (b - a), [0.0] * (b - a)
                if lengths.sum():
                    rows = scored.rows([w for ws in found for w in ws])
                    p, _ = posteriors(rows.astype(np.float64), segments(lengths), m.start, m.move)
                    has = np.flatnonzero(lengths)
                    share = np.add.reduceat(p, (np.cumsum(lengths) - lengths)[has], axis=0) / lengths[has, None]
                    for i, best, s in zip(has, share.argmax(axis=1), share.max(axis=1)):
                        best_lang[i], best_score[i] = m.languages[best], float(min(1.0, s))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best_lang, pa.string()), pa.array(best_score, pa.float64())], names=[*names, lang, score])

    return docs.select(*names).mapInArrow(run, schema)


def fit(docs: DataFrame) -> Model:
    """A field trained on the documents whose crc32(doc_id as text) mod 3 is not 1.

    One task has the sample and trains on it; the driver gets the field alone.
    """

    def run(batches):
        rows = in_order([r for batch in batches for r in batch.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])

    learns = docs.filter(shared.crc_remainder(F.col("doc_id"), 3) != 1)
    found = picked(learns).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([])


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (shared.crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
