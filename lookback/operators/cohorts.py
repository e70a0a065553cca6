"""Weekly cohorts: first citations, funnels, and what moved between two weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import first_days, first_occurrences


def week_of(day: str) -> Column:
    return F.to_date(F.date_trunc("WEEK", F.col(day)))


def first_citations(cited: DataFrame, key: list[str], line: str, day: str) -> DataFrame:
    """week, line (null: all), papers: different papers first cited in a week; a paper counts for every line that cites it that day."""
    firsts = first_occurrences(cited.select(*key, line, day).distinct(), key, day).withColumn("week", week_of(day))
    paper = F.struct(*key)
    return firsts.groupingSets([["week"], ["week", line]], "week", line).agg(F.count_distinct(paper).alias("papers"))


def funnel(steps: DataFrame, key: list[str], step: str, day: str, order: list[str], within: int = 7) -> DataFrame:
    """week and, for each step, how many of the keys first seen that week reached it: within days of the first one, and
    only by way of the steps before."""
    firsts = steps.groupBy(*key).agg(*[F.min(F.when(F.col(step) == s, F.col(day))).alias(f"_{i}") for i, s in enumerate(order)])
    base, reached = firsts.filter(F.col("_0").isNotNull()), F.lit(True)
    columns = []
    for i, s in enumerate(order):
        reached = reached & F.coalesce((F.col(f"_{i}") >= F.col("_0")) & (F.datediff(f"_{i}", "_0") <= within), F.lit(False))
        columns.append(F.sum(reached.cast("long")).alias(s))
    return base.withColumn("week", week_of("_0")).groupBy("week").agg(*columns)


def shifts(counts: DataFrame, old: dict[str, str], new: dict[str, str], whole: str) -> DataFrame:
    """factor, change (of the logarithm), error, beyond_noise for each factor.

    old and new name columns of a one-row frame: the `whole` factor's count, and for the others a share's reached and
    tried as reached/tried. A count's error is 1/sqrt(count); a share's variance of the logarithm is 1/reached - 1/tried.
    """
    rows = []
    for name in old:
        parts = []
        for spec in (old[name], new[name]):
            k, _, n = spec.partition("/")
            value = F.col(k).cast("double") if not n else F.col(k) / F.col(n)
            variance = 1 / F.col(k) if not n else 1 / F.col(k) - 1 / F.col(n)
            ok = F.col(k) > 0
            parts.append((F.when(ok, F.log(value)), F.when(ok, variance)))
        change, error = parts[1][0] - parts[0][0], F.sqrt(parts[0][1] + parts[1][1])
        rows.append(F.struct(F.lit(name).alias("factor"), change.alias("change"), error.alias("error"), (F.abs(change) > 1.96 * error).alias("beyond_noise")))
    return counts.select(F.inline(F.array(*rows)))


def repeats(posted: DataFrame, key: list[str], day: str) -> DataFrame:
    """week, slots, repeats: postings of the week, and those whose key was posted on an earlier day."""
    firsts = first_days(posted, key, day, "_first")
    return posted.join(firsts, key).groupBy(week_of(day).alias("week")).agg(F.count("*").alias("slots"), F.count_if(F.col("_first") < F.col(day)).alias("repeats"))


def poisoned_sum(value: Column) -> Column:
    """The sum, null if any value is."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))
