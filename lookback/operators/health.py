"""Can a measurement be trusted on a day: readings, their status, and the status of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import with_streak

# Statuses, the worst first; the first five are failures.
STATUSES = ("missing", "contradiction", "unexplained-zero", "stuck", "insufficient-n", "declared-degenerate", "live", "expected-zero")
FAILURES = STATUSES[:4]


def reading_status(value: Column, conflict: Column, expect: Column, day: Column, review_by: Column) -> Column:
    """One reading: expect is zero, positive, agrees (with a positive reading beside it) or any."""
    return (
        F.when(value.isNull(), "missing")
        .when(conflict.isNotNull(), "contradiction")
        .when((value > 0) & (expect == "zero"), "contradiction")
        .when(value > 0, "live")
        .when(expect == "agrees", "contradiction")
        .when(review_by.isNotNull() & (day > review_by), "unexplained-zero")
        .when(review_by.isNotNull(), "declared-degenerate")
        .when(expect == "positive", "unexplained-zero")
        .otherwise("expected-zero")
    )


def with_stuck(cells: DataFrame, group: list[str], day: str, value: str, after: int) -> DataFrame:
    """status becomes stuck from the after-th equal live value in a row on."""
    ran = with_streak(cells, group, day, value, F.col("status") == "live", "_streak")
    return ran.withColumn("status", F.when(F.col("_streak") >= after, "stuck").otherwise(F.col("status"))).drop("_streak")


def window_status(cells: DataFrame, group: list[str], least: int) -> DataFrame:
    """status of each group's cells: the worst failure, else insufficient-n, declared-degenerate, live, expected-zero."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    status = F
    for k, s in enumerate(FAILURES):
        status = F.when(any_(s), s) if k == 0 else status.when(any_(s), s)
    status = status.when(F.count("*") < least, "insufficient-n").when(any_("declared-degenerate"), "declared-degenerate").when(any_("live"), "live").otherwise("expected-zero")
    return cells.groupBy(*group).agg(status.alias("status"), F.count("*").alias("cells"))


def dense(observed: DataFrame, groups: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every group on every tick day, with the reading where there is one; groups and days are dimension tables."""
    return groups.crossJoin(F.broadcast(days)).join(observed, keys, "left")


def listing_quiet(at: Column, holidays: list[str]) -> Column:
    """A listing fetched at a time (UTC) is empty: its day, by a fixed UTC-5, is at a weekend or the day after a holiday."""
    day = F.to_date(at - F.expr("INTERVAL 5 HOURS"))
    after = F.date_sub(day, 1).isin(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.lit(False)
    return weekend(day) | after


def daily_quiet(at: Column) -> Column:
    """A list of the UTC day before is empty if that is at a weekend."""
    return weekend(F.date_sub(F.to_date(at), 1))


def caveats(cells: DataFrame, part: str, group: list[str]) -> DataFrame:
    """group, doubted (lines in doubt), worst status, some: whether any doubted line has a part of the sum beside which it stands.

    cells: line, status, and part, what the line adds to the sum.
    """
    doubted = cells.filter(F.col("status").isin(*FAILURES))
    rank = F.array_position(F.array(*map(F.lit, FAILURES)), F.col("status"))
    found = doubted.groupBy(*group).agg(F.count_distinct("line").alias("doubted"), F.min(rank).alias("_r"), F.bool_or(F.col(part) > 0).alias("some"))
    return found.select(*group, "doubted", F.element_at(F.array(*map(F.lit, FAILURES)), F.col("_r").cast("int")).alias("worst"), "some")


def status_counts(cells: DataFrame, group: list[str]) -> DataFrame:
    """group, status, n, and the first day that gave the status."""
    return cells.groupBy(*group, "status").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


def weekend(day: Column) -> Column:
    return F.weekday(day) >= 5
