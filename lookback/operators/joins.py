"""Joins in time and by citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved_citations(logs: DataFrame, claims: str, cited: str) -> DataFrame:
    """Each citation number of a log with the claim it means, null where the log has no such claim."""
    return logs.withColumn("n", F.explode(cited)).withColumn("claim", F.try_element_at(F.col(claims), F.col("n")))


def used_verdicts(marks: DataFrame, sightings: DataFrame, mark: list[str], key: list[str], today: Column, window: int = 30) -> DataFrame:
    """verdict and seen_on of every mark against the sightings of its key.

    marks: surfaced_on, observed_from; sightings: first_seen, baseline, unsure. A sighting by the surfacing day, or a
    baseline or unsure one, leaves it unknown; one within the window is use; an open window is pending; a scan that began
    inside the window leaves an unseen mark unknown. Sightings are summed up by key before the join, so that a key meets its marks
    as one row.
    """
    flagged = F.coalesce("baseline", F.lit(False)) | F.coalesce("unsure", F.lit(False))
    each = sightings.groupBy(*key).agg(F.min("first_seen").alias("_seen"), F.bool_or(flagged).alias("_flag"))
    joined = marks.join(each, key, "left").groupBy(*mark, *key, "surfaced_on", "observed_from")
    summed = joined.agg(F.min("_seen").alias("_seen"), F.coalesce(F.bool_or("_flag"), F.lit(False)).alias("_flag"))
    summed = summed.withColumn("_before", F.col("_flag") | F.coalesce(F.col("_seen") <= F.col("surfaced_on"), F.lit(False)))
    closes = F.date_add("surfaced_on", window)
    used = F.coalesce(F.col("_seen") <= closes, F.lit(False))
    verdict = F.when(F.col("_before"), "unknown").when(used, "used").when(today < closes, "pending").when(F.col("observed_from") > F.col("surfaced_on"), "unknown").otherwise("unused")
    return summed.select(*mark, *key, "surfaced_on", verdict.alias("verdict"), F.when(verdict == "used", F.col("_seen")).alias("seen_on"))


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time (of equal times, the greatest values).

    Both sides are sorted together once by key and time; no row meets all earlier ones.
    """
    row = F.struct(F.col(right_time).alias("_t"), *values)
    marked = right.select(*key, F.col(right_time).alias("_time"), row.alias("_found"), F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_left"))
    asked = left.select(*key, F.col(left_time).alias("_time"), F.lit(None).cast(marked.schema["_found"].dataType).alias("_found"), F.struct("*").alias("_left"))
    # equal times: found rows come first, the greatest values last of them
    order = Window.partitionBy(*key).orderBy("_time", F.col("_left").isNotNull(), *[F.col(f"_found.{v}") for v in values]).rowsBetween(Window.unboundedPreceding, 0)
    seen = marked.unionByName(asked).withColumn("_found", F.last("_found", ignorenulls=True).over(order))
    return seen.filter(F.col("_left").isNotNull()).select("_left.*", *[F.col(f"_found.{v}").alias(v) for v in values])


def retries(fetched: DataFrame, judged: DataFrame, open_questions: DataFrame, key: str, question: str, day: str, today: Column, days: int = 14, most: int = 40) -> DataFrame:
    """What was fetched within days and not judged since, for questions still open: the oldest first."""
    recent = fetched.filter((F.datediff(today, F.col(day)) >= 0) & (F.datediff(today, F.col(day)) <= days))
    waiting = recent.join(judged.select(key).distinct(), key, "left_anti").join(open_questions.select(question).distinct(), question, "left_semi")
    return waiting.orderBy(day, key, *[c for c in waiting.columns if c not in (day, key)]).limit(most)
