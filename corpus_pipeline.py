"""A corpus pipeline: documents through operators of lookback.llm, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookback.llm import langid, mixing, neardup, packing, quality, shared

#: A document whose words give less of their probability to any one language is rejected.
LEAST_LANGUAGE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter or no language of at least LEAST_LANGUAGE.

    Null and empty texts have no letter and go. Rows with a null or repeated doc_id are judged each by its text. Where no
    document has a known language all go; an empty table stays empty. Other columns pass through, but for two names that
    are reserved: _lang_pred and _lang_score.
    """
    found = langid.predict(docs, langid.fit(docs), "_lang_pred", "_lang_score")
    return found.filter((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= LEAST_LANGUAGE)).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules or are likelier in the raw corpus than in trusted text.

    Null and empty texts have too few words and go. Rows with a null or repeated doc_id are judged each by its text. An
    empty table stays empty. Other columns pass through, whatever their names.
    """
    row = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return quality.passed(row, shared.table(spark, sf_dir, "labels")).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8), the one with the smallest doc_id.

    Texts without words are near nothing and stay. If rows have a null or repeated doc_id, all rows are numbered first
    and decided by their numbers: each of them stays or goes by its own text, and of a group any one row stays. An empty
    table stays empty. Other columns pass through; _row and _id are reserved.
    """
    ids = docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    if ids.limit(1).count():
        numbered = shared.materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_id")), "numbered")
        found = neardup.near_duplicates(numbered.select(F.col("_id").alias("doc_id"), F.col("_row.text").alias("text")))
        kept = shared.materialize(found.filter("kept").select(F.col("doc_id").alias("_id")), "kept")
        return numbered.join(kept, "_id", "left_semi").select("_row.*")
    kept = shared.materialize(neardup.near_duplicates(docs).filter("kept").select("doc_id"), "kept")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; reruns take the same.

    Null and empty texts have no size and are taken as often as others of their source. A null source is one of its own.
    Rows that repeat a doc_id are drawn alike. An empty table stays empty. Other columns pass through.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens.

    Null and empty texts are a piece of the end id alone; every row is a document, whatever its doc_id. Very long texts
    are cut into full pieces and a last one. An empty table gives an empty one. Other columns are not read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Token ids and trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all STAGES."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
