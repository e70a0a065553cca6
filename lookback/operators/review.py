"""The weekly review: what it repeats, what its author did, what is exceptional, and all of it as one row a week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import states
from .cohorts import week_of
from .health import FAILURES


def review_repeats(shown: DataFrame, posted: DataFrame, key: list[str], day: str) -> DataFrame:
    """week, entries, repeats: what a week's reviews showed, and how much of it an earlier day's review or note had shown.

    A week without entries has no row. shown, posted: key, day; rows of one key and day count each.
    """
    first_shown = shown.groupBy(*key).agg(F.min(day).alias("_shown"))
    first_posted = posted.groupBy(*key).agg(F.min(day).alias("_posted"))
    rows = shown.join(first_shown, key).join(first_posted, key, "left")
    before = F.least("_shown", "_posted") < F.col(day)  # least() passes over nulls
    return rows.groupBy(week_of(day).alias("week")).agg(F.count("*").alias("entries"), F.count_if(before).alias("repeats"))


def author_signal(labels: DataFrame, weeks: DataFrame, recent: int = 14) -> DataFrame:
    """week, ticks, positives, added, unknown for each week (the Monday) of `weeks`.

    labels: line, paper (null: not one), verdict, provenance, log (whether the subject is a question's day), first (day of the
    first harvest; null: not known). ticks: question days' boxes of the week. positives: papers of a line that are correct
    as of the week's end; added: those first so within `recent` days; unknown: those of which any label's first day isn't known.

    A paper's labels are summed to one row before weeks come in: its first day, or that there is none.
    """
    good = labels.filter((F.col("verdict") == "correct") & F.col("paper").isNotNull())
    # a label without a first day counts in every week, and leaves its paper's first day unknown
    papers = good.groupBy("line", "paper").agg(F.min("first").alias("first"), F.bool_or(F.col("first").isNull()).alias("unsure"))
    days = papers.groupBy(F.when(~F.col("unsure"), F.col("first")).alias("first")).agg(F.count("*").alias("n"))  # a row a day
    every, end, n = weeks.select("week").distinct(), F.date_add("week", 6), F.col("n")
    at = F.broadcast(every).join(days, F.col("first").isNull() | (F.col("first") <= end))
    counted = at.groupBy("week").agg(F.sum("n").alias("positives"), F.sum(F.when(F.col("first") > F.date_sub(end, recent), n)).alias("added"), F.sum(F.when(F.col("first").isNull(), n)).alias("unknown"))
    boxes = labels.filter((F.col("provenance") == "question_day") & F.col("log")).groupBy(week_of("first").alias("week")).agg(F.count("*").alias("ticks"))
    out = every.join(counted, "week", "left").join(boxes, "week", "left")
    return out.select("week", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ticks", "positives", "added", "unknown")])


def exceptions(lines: DataFrame, cells: DataFrame, questions: DataFrame, week: str = "week") -> DataFrame:
    """week, zero_lines (lines whose count is 0), failing (instruments with a failing status), stuck (open questions that
    didn't move), exceptions (their sum).

    lines: week, line, count. cells: week, instrument, status. questions: week, question, moved.
    """
    zero = lines.groupBy(week).agg(F.count_if(F.col("count") == 0).alias("zero_lines"))
    failing = cells.groupBy(week).agg(F.count_distinct(F.when(F.col("status").isin(*FAILURES), F.col("instrument"))).alias("failing"))
    stuck = questions.groupBy(week).agg(F.count_if(~F.coalesce("moved", F.lit(False))).alias("stuck"))
    out = zero.join(failing, week, "full").join(stuck, week, "full")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("zero_lines", "failing", "stuck")]
    return out.select(week, *counts).withColumn("exceptions", F.col("zero_lines") + F.col("failing") + F.col("stuck"))


def review_rows(parts: dict[str, DataFrame], week: str = "week") -> DataFrame:
    """week and row, one JSON object a week with a part for each table of parts (one row a week; null where it has none)."""
    weeks = None
    for name, part in parts.items():
        own = part.select(week, F.struct(*[F.col(c) for c in part.columns if c != week]).alias(name))
        weeks = own if weeks is None else weeks.join(own, week, "full")
    body: Column = F.struct(F.col(week).cast("string").alias(week), *parts)
    return states.with_json(weeks, "row", body).select(week, "row")
