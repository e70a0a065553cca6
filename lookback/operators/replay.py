"""What another policy would have done: outcomes, cells, fits, and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(pairs: DataFrame, stratum: str, kept_now: Column, kept_then: Column, gold: Column) -> DataFrame:
    """By stratum and both policies' verdicts: population, labelled, positive."""
    grouped = pairs.groupBy(F.col(stratum).alias("stratum"), kept_now.alias("kept_now"), kept_then.alias("kept_then"))
    return grouped.agg(F.count("*").alias("population"), F.count(gold).alias("labelled"), F.coalesce(F.sum(gold.cast("long")), F.lit(0)).alias("positive"))


def kept_score(pairs: DataFrame, split: str, now: Column, then: Column, gold: Column) -> DataFrame:
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return pairs.groupBy(split).agg(
        count(now).alias("kept_now"), count(then).alias("kept_then"), count(then & ~now).alias("gained"), count(now & ~then).alias("lost"),
        count(now & gold).alias("gold_now"), count(then & gold).alias("gold_then"), F.count(gold).alias("labelled"), count(now != then).alias("changed"),
    )


def fit_threshold(labelled: DataFrame, score: str, gold: str, current: float, weight: str | None = None, least: int = 10, gain: float = 0.01) -> DataFrame:
    """One row: threshold, accuracy, now (accuracy of the current one), adopt.

    The grid is 0.05 to 0.95 by 0.05; ties go to the threshold nearest the current one. adopt needs `least` labels with
    both classes among them, and a gain. Labels are summed by the grid step that their score reaches; the grid then
    sums 19 rows, not the labels again for each step.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    step = F.least(F.lit(19), F.greatest(F.lit(0), F.floor(F.round(F.col(score) * 20, 9)).cast("int")))
    by_step = labelled.groupBy(step.alias("step")).agg(
        F.sum(F.when(F.col(gold), w).otherwise(0.0)).alias("positive"), F.sum(F.when(~F.col(gold), w).otherwise(0.0)).alias("negative"),
        F.count("*").alias("n"), F.count_if(F.col(gold)).alias("n_positive"),
    )
    grid = labelled.sparkSession.range(1, 20).select((F.col("id") * 5 / 100).alias("threshold"), F.col("id").cast("int").alias("cut"))
    every = grid.unionByName(labelled.sparkSession.range(1).select(F.lit(current).alias("threshold"), F.lit(current * 20).cast("int").alias("cut")))
    sums = every.distinct().crossJoin(F.broadcast(by_step)).groupBy("threshold", "cut").agg(
        F.sum(F.when(F.col("step") >= F.col("cut"), F.col("positive")).otherwise(F.col("negative"))).alias("right"),
        F.sum(F.col("positive") + F.col("negative")).alias("all"), F.sum("n").alias("n"), F.sum("n_positive").alias("n_positive"),
    )
    scored = sums.select("threshold", (F.col("right") / F.col("all")).alias("accuracy"), "n", "n_positive")
    now = F.max(F.when(F.abs(F.col("threshold") - current) < 1e-9, F.col("accuracy"))).over(Window.partitionBy())
    best = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("accuracy", 9)), F.round(F.abs(F.col("threshold") - current), 9), "threshold"))
    top = scored.withColumn("now", now).withColumn("_r", best).filter("_r = 1")
    enough = (F.col("n") >= least) & (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n")) & (F.col("accuracy") - F.col("now") >= gain - 1e-9)
    return top.select("threshold", "accuracy", "now", enough.alias("adopt"))


def incidence(found: DataFrame, item: list[str], unit: str) -> DataFrame:
    """One row: found, once, twice, units: items by how many units found them."""
    each = found.groupBy(*item).agg(F.count_distinct(unit).alias("_units"))
    units = found.agg(F.count_distinct(unit).alias("units"))
    sums = each.agg(F.count("*").alias("found"), F.count_if(F.col("_units") == 1).alias("once"), F.count_if(F.col("_units") == 2).alias("twice"))
    return sums.crossJoin(F.broadcast(units))


def agreement(df: DataFrame, one: str, two: str, options: list) -> DataFrame:
    """The confusion of two verdicts: a row for each of the first, a column n_<option> for each of the second."""
    return df.groupBy(one).agg(*[F.count_if(F.col(two) == o).alias(f"n_{o}") for o in options], F.count("*").alias("n"))
