"""Mixing sources to target weights (operator 10), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Up to so many sources, their targets are reckoned in one task and broadcast; beyond it, by ranges and a shuffled join.
SOURCE_BOUND = 100_000


def document_sizes(text):
    return F.size(shared.words(text)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float, bound: int = SOURCE_BOUND) -> tuple[DataFrame, bool]:
    """One row a source: source, source_size, target; and whether there are few enough to broadcast.

    Sources by code point, null last, take the weights in turn. A target is least(most * size, level * weight) with
    the level at which targets add up to share * all sizes. With sources in order of most * size / weight, the level
    is the greatest (total - sum of the limits before) / (weights from here on): it rises while sources reach their
    limit and falls after that.
    """
    named = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    named = shared.materialize(named, "sources")
    few = named.count() <= bound
    by_name = [F.col("_source").isNull(), F.col("_source")]
    if few:
        named = named.withColumn("_rank", F.row_number().over(Window.orderBy(*by_name)) - 1)
    else:
        named = shared.running(shared.spread(named, by_name, 64, "sources-named"), by_name, {"_rank": F.lit(1)})
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = named.select("_source", "source_size", pick.alias("_weight"), (F.col("source_size") * F.lit(float(most))).alias("_limit"))
    by_limit = [F.col("_limit") / F.col("_weight"), *by_name]
    sums = {"_limits": F.col("_limit"), "_weights": F.col("_weight")}
    if few:
        before = Window.orderBy(*by_limit).rowsBetween(Window.unboundedPreceding, -1)
        ordered = weighed.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(k) for k, c in sums.items()])
    else:
        ordered = shared.running(shared.spread(weighed, by_limit, 64, "sources-weighed"), by_limit, sums)
    whole = weighed.agg((F.sum("source_size") * F.lit(float(share))).alias("_total"), F.sum("_weight").alias("_all_weights"))
    level = ordered.crossJoin(F.broadcast(whole)).agg(F.max((F.col("_total") - F.col("_limits")) / (F.col("_all_weights") - F.col("_weights"))).alias("_level"))
    targets = weighed.crossJoin(F.broadcast(level)).select("_source", "source_size", F.least("_limit", F.col("_level") * F.col("_weight")).alias("target"))
    return targets, few


def uniform(key, seed: str):
    """A number from 0 to 1 for each key, from the first 52 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", bound: int = SOURCE_BOUND) -> DataFrame:
    """documents with _size, source_size, target, and _copies: how often the mix takes each.

    A source's rate is target / source_size. Each document is taken floor(rate) times, and once more if a number
    hashed from seed and doc_id is below the fraction. Null texts and texts without a word have size 0; a source of
    size 0 has target and rate 0. A null source is a source of its own, the last. Rows that repeat a doc_id are taken
    equally often. An empty table gives an empty one. Other columns pass through; names beginning with _ are the
    operator's own and must not be among them.
    """
    sized = docs.withColumn("_size", document_sizes(F.col("text")))
    targets, few = source_targets(sized.select(F.col("source").alias("_source"), "_size"), list(weights), share, most, bound)
    targets = F.broadcast(targets) if few else targets
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    fraction = rate - F.floor(rate)
    return joined.withColumn("_copies", F.floor(rate) + (uniform(F.col("doc_id"), seed) < fraction).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the rows of documents, each as often as the mix takes it."""
    plan = mix_plan(docs.withColumn("_row", F.struct("*")).select("_row", "doc_id", "text", "source"), **options)
    taken = plan.filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).select("_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len([w for w in regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+') if w <> '']) AS BIGINT) AS size
  FROM documents),
named AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM named),
weighed AS (SELECT source, source_size, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(w) OVER o, 0) AS ws FROM weighed
  WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max(((SELECT sum(source_size) FROM weighed) * 1.5::DOUBLE - caps) / ((SELECT sum(w) FROM weighed) - ws)) AS l FROM ordered),
targets AS (SELECT source, source_size, least(cap, l * w) AS target FROM weighed, level),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
