"""The same questions over streams: first sightings, weekly counts that close, upserts a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import keyed


def first_sightings(stream: DataFrame, path: str, key: list[str], time: str, checkpoint: str) -> StreamingQuery:
    """Keeps the first arrival of each key in a table (see keyed.add_first) and ends; run again it takes what is new.

    What the table has is never replaced, however late a key comes again, and only the buckets that a batch's keys are in
    are written. A batch that runs twice changes nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        keyed.add_first(batch.sparkSession, path, batch, key, time)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(stream: DataFrame, time: str, by: list[str], maturity: str = "7 days") -> DataFrame:
    """Events a week and group; a week's row comes once it is `maturity` past. Weeks start on Monday."""
    week = F.window(time, "7 days", "7 days", "4 days")  # the epoch's first Monday is 4 days in
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, maturity).groupBy(week, *by).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("week"), *by, "n")


def upsert_stream(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Upserts all that is there into a table (see keyed.upsert) and ends; run again it takes what is new. A batch writes the
    buckets that its keys are in; one that runs twice changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        keyed.upsert(batch.sparkSession, path, batch.withColumn("_n", F.col(order)), key, "_n")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delayed_labels(surfaced: DataFrame, seen: DataFrame, key: str, days: int, late: str = "1 day") -> DataFrame:
    """surfaced (key, surfaced_at) with the time it was seen within days of it, null once that time has passed without."""
    left = surfaced.withWatermark("surfaced_at", late)
    right = seen.select(F.col(key).alias("_key"), "seen_at").withWatermark("seen_at", late)
    within = F.expr(f"{key} = _key AND seen_at >= surfaced_at AND seen_at <= surfaced_at + INTERVAL {days} DAYS")
    return left.join(right, within, "leftOuter").drop("_key")
