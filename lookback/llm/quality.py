"""Quality rules (operator 2): counts of a text, and how much likelier its n-grams are in trusted text; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Buckets of hashed n-grams, and bitmaps of trusted ids (4 KB each, of 32,768 neighbouring ids) that are broadcast at most;
#: with more of them, texts and ids are joined by a shuffle, which gives the same.
BUCKETS, BITMAPS = 1 << 14, 4_096
#: Documents whose mean log ratio is lower are rejected.
THRESHOLD = -0.3
#: What each side's count is smoothed with, in parts of the other side's distribution (target) or as a constant (raw).
PRIOR = 0.5
SYMBOLS = "[#*$%&|<>]"
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def base_columns(text: Column) -> dict[str, Column]:
    """Columns to add one after the other: words and the four counts. See quality() for what they count."""
    windows, first, lines = F.col("_windows"), F.col("_sorted"), F.col("_lines")
    w = F.col("_words")
    n = F.size(w)
    # window hashes; a text of fewer than three words has no window
    hashed = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda j, k: F.coalesce(F.try_element_at(first, j)["h"] == F.try_element_at(first, k)["h"], F.lit(False))
    # places of windows that occur twice or more: neighbours in hash order have the same hash
    found = F.filter(F.transform(first, lambda s, k: F.when(same(k + 1, k + 2) | (F.when(k > 0, same(k + 1, F.greatest(k, F.lit(1)))).otherwise(F.lit(False))), s["i"])), lambda i: i.isNotNull())
    starts = F.col("_starts")
    covered = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - a["end"])).cast("long").alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    return {
        "_words": shared.words(text),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
        "_lines": F.coalesce(F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(shared.BLANKS))) > 0), F.array().cast("array<string>")),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "_windows": hashed,
        # most texts repeat no window; only others are sorted
        "_sorted": F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed),
        "_starts": F.when(first.isNotNull(), F.sort_array(found)),
        "n_repeat_words": F.when(starts.isNotNull(), covered).otherwise(F.lit(0).cast("long")),
    }


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    for name, column in base_columns(F.col(text)).items():
        docs = docs.withColumn(name, column)
    return docs


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def hashed_ngrams(text: Column) -> tuple[Column, Column]:
    """The tokens of a text (runs of word characters, or of others, lower-cased), and from the column _tokens the
    buckets of its unigrams and bigrams."""
    t = F.col("_tokens")
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKENS), F.lit(0)), F.array().cast("array<string>"))
    one = F.transform(t, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    two = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return found, F.concat(one, two)


def marked(docs: DataFrame, good: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """doc_id, text and _trusted: 1 where good (doc_id, each once, none null) has the id, else null. Speed alone depends on bitmaps."""
    if {str(t.schema["doc_id"].dataType) for t in (docs, good)} == {"LongType()"}:
        place = F.bitmap_bit_position("doc_id")
        bits = good.groupBy(F.bitmap_bucket_number("doc_id").alias("_group")).agg(F.bitmap_construct_agg(place).alias("_bits"))
        bits = shared.materialize(bits, "trusted-bits")
        if bits.count() <= bitmaps:
            byte = F.conv(F.hex(F.substr("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            held = F.when(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(1))
            placed = docs.select("doc_id", "text").withColumn("_group", F.bitmap_bucket_number("doc_id"))
            return placed.join(F.broadcast(bits), "_group", "left").select("doc_id", "text", held.alias("_trusted"))
    return docs.select("doc_id", "text").join(good.withColumn("_trusted", F.lit(1)), "doc_id", "left")


def log_ratios(docs: DataFrame, labels: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """bucket, ratio: log(p_target / p_raw) of every bucket that occurs.

    Raw counts are over all documents, target counts over all trusted ones (quality 1 and not toxic), however many there
    are. Both are smoothed: raw with PRIOR, target with PRIOR times the bucket's raw probability times BUCKETS, so that a
    bucket that trusted text lacks gets a finite ratio and one that the corpus lacks gets none.
    """
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    good = shared.materialize(good.select("doc_id").distinct(), "trusted")
    found, buckets = hashed_ngrams(F.col("text"))
    grams = marked(docs, good, bitmaps).withColumn("_tokens", found).select(F.explode(buckets).alias("bucket"), "_trusted")
    counts = shared.materialize(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target")), "ngram-counts")
    # no more rows than buckets from here on
    sums = counts.agg(F.sum("raw").alias("n"), F.sum("target").alias("m"))
    p_raw = (F.col("raw") + PRIOR) / (F.col("n") + PRIOR * BUCKETS)
    p_target = (F.col("target") + PRIOR * BUCKETS * p_raw) / (F.col("m") + PRIOR * BUCKETS)
    return counts.crossJoin(F.broadcast(sums)).select("bucket", F.log(p_target / p_raw).alias("ratio"))


def ratio_array(ratio: DataFrame) -> DataFrame:
    """The ratios as one row with an array by bucket (0 where there is none): BUCKETS numbers, whatever the input."""
    every = ratio.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(ratio, "bucket", "left").select("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    listed = full.agg(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))).alias("l"))
    return listed.select(F.transform("l", lambda x: x["ratio"].cast("float")).alias("_ratios"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ratio, base_failed, kept to every row.

    words are runs of other characters than [\\x20\\x09-\\x0D]; word_chars their code points; n_symbols characters of
    [#*$%&|<>]; n_dup_lines lines with a word that equal an earlier one; n_repeat_words words in three-word windows that
    occur twice or more. A row fails the base rules with fewer than 50 words or more than half of them repeated.
    log_ratio is the mean over a text's hashed unigrams and bigrams of log(p_target / p_raw), 0 without any. A row is
    kept if it passes the base rules and log_ratio >= threshold. Null texts have no words. Rows that repeat a doc_id are
    judged each by its text. Without trusted documents all ratios are 0. An empty table gives an empty one. Other columns
    pass through; names beginning with _ are the operator's own and must not be among them. To filter the result, write it
    down first or take passed().
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios = shared.materialize(ratio_array(log_ratios(docs, labels)), "ratios")
    found, buckets = hashed_ngrams(F.col("text"))
    grams = F.col("_grams")
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.col("_ratios")[b])
    based = with_base(docs.drop(*added, "log_ratio", "base_failed", "kept")).withColumn("_tokens", found).withColumn("_grams", buckets)
    scored = based.crossJoin(F.broadcast(ratios)).withColumn("log_ratio", F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0)))
    kept = ~base_failed() & (F.col("log_ratio") >= threshold)
    passed = [c for c in docs.columns if c not in {*added, "log_ratio", "base_failed", "kept"}]
    return scored.select(*passed, *added, "log_ratio", base_failed().alias("base_failed"), kept.alias("kept"))


def passed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of quality() that are kept.

    The filter also reads a row number, so that Spark doesn't move it below the columns that it reads: there it would
    hold their expressions over and over, each column's within the next one's.
    """
    placed = quality(docs, labels).withColumn("_place", F.monotonically_increasing_id())
    return placed.filter(F.col("kept") & (F.col("_place") >= 0)).drop("_place")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (shared.table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = quality(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")
