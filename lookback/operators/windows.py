"""First, latest, previous and capped rows of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_days(df: DataFrame, key: list[str], day: str, out: str = "first_day") -> DataFrame:
    return df.groupBy(*key).agg(F.min(day).alias(out))


def first_occurrences(df: DataFrame, key: list[str], day: str) -> DataFrame:
    """All rows of each key's first day. A join with first days, so that map-side minima come before any shuffle of rows."""
    firsts = first_days(df, key, day, "_first")
    return df.join(firsts, [*key], "inner").filter(F.col(day) == F.col("_first")).drop("_first")


def latest(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row of each key, the last in the given order."""
    columns = [c for c in df.columns if c not in key]
    place = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)])
    best = df.groupBy(*key).agg(F.max_by(F.struct(*columns), place).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def with_previous(df: DataFrame, group: list[str], order: str, value: str, out: str = "previous") -> DataFrame:
    """Adds the latest value before each row that isn't null."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(before))


def with_streak(df: DataFrame, group: list[str], order: str, value: str, live: Column, out: str = "streak") -> DataFrame:
    """Adds to live rows how many live rows in a row had this value; other rows are skipped and get null."""
    rows = Window.partitionBy(*group, "_live").orderBy(order)
    marked = df.withColumn("_live", F.coalesce(live, F.lit(False)))
    changed = marked.withColumn("_change", F.coalesce(F.col(value) != F.lag(value).over(rows), F.lit(True)).cast("int"))
    island = changed.withColumn("_island", F.sum("_change").over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = F.row_number().over(Window.partitionBy(*group, "_live", "_island").orderBy(order))
    return island.withColumn(out, F.when(F.col("_live"), numbered)).drop("_live", "_change", "_island")


def claims_per_question(questions: Column) -> Column:
    """5 for one question, down to 2 from five on."""
    return F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.lit(9) / questions).cast("int")))


def capped(df: DataFrame, question: str, source: str, *rank: Column, per_question: int, per_source: int = 2) -> DataFrame:
    """Per question the first per_question rows by rank, of each source per_source at most.

    Two limits by row number equal the walk down the ranks; Spark limits each task's rows before either shuffle.
    """
    of_source = Window.partitionBy(question, source).orderBy(*rank)
    of_question = Window.partitionBy(question).orderBy(*rank)
    few = df.withColumn("_s", F.row_number().over(of_source)).filter(F.col("_s") <= per_source)
    return few.withColumn("place", F.row_number().over(of_question)).filter(F.col("place") <= per_question).drop("_s")


def top_bridges(df: DataFrame, question: str, source: str, score: str, per_question: int = 3, most: int = 5) -> DataFrame:
    """The likeliest few of each question, and the likeliest of those with each source once."""
    order = [F.desc(score), F.asc(source)]
    near = df.withColumn("_q", F.row_number().over(Window.partitionBy(question).orderBy(*order))).filter(F.col("_q") <= per_question)
    once = near.withColumn("_s", F.row_number().over(Window.partitionBy(source).orderBy(F.desc(score), question))).filter("_s = 1")
    return once.orderBy(*order).limit(most).drop("_q", "_s")


def interleaved(df: DataFrame, kind: str, *order: Column, out: str = "turn") -> DataFrame:
    """Adds each row's turn: rows of each kind keep their order, and kinds take turns."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(kind).orderBy(*order)))


def rotated(position: Column, turn: Column | int, n: Column) -> Column:
    """The place of a list's entry in the turn-th run, when each run starts one entry later."""
    return F.pmod(position - turn, n)


def within_budget(df: DataFrame, group: list[str], size: Column, budget: int, *order: Column) -> DataFrame:
    """The rows of each group that fit the budget together, in order."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_used", F.sum(size).over(upto)).filter(F.col("_used") <= budget).drop("_used")
