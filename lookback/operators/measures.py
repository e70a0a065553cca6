"""Shares, yields, spends, differences between arms and repeated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics
from . import windows


def shares(df: DataFrame, by: str) -> DataFrame:
    """by, n and share of all rows; the sum is over as many rows as there are groups."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all")))).select(by, "n", (F.col("n") / F.col("_all")).alias("share"))


def found_and_unique(found: DataFrame, item: list[str], by: str) -> DataFrame:
    """by, found (different items), unique (those that no other group found)."""
    each = found.select(*item, by).distinct()
    alone = each.groupBy(*item).agg(F.count("*").alias("_n"))
    return each.join(alone, item).groupBy(by).agg(F.count("*").alias("found"), F.count_if(F.col("_n") == 1).alias("unique"))


def only_one_arm(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key and arm (a or b) of what only one of two arms found."""
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    return left.exceptAll(right).withColumn("arm", F.lit("a")).unionByName(right.exceptAll(left).withColumn("arm", F.lit("b")))


def trailing_yields(sends: DataFrame, query: str, order: str, fresh: str, keep: int = 5, dry: int = 3) -> DataFrame:
    """query, yields of its last `keep` sends (oldest first), exhausted: at least `dry` sends, and nothing new in the last of them."""
    last = sends.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(order)))).filter(F.col("_r") <= keep)
    listed = F.array_sort(F.collect_list(F.struct(-F.col("_r"), F.col(fresh).alias("n"))))
    late = F.max(F.when(F.col("_r") <= dry, F.col(fresh)))
    return last.groupBy(query).agg(F.transform(listed, lambda x: x["n"]).alias("yields"), ((F.count("*") >= dry) & (late == 0)).alias("exhausted"))


def slots(claims: DataFrame, run: list[str], question: str, per_question: Column) -> DataFrame:
    """run, free and slots: per question room for per_question(questions) claims."""
    each = claims.groupBy(*run, question).agg(F.count("*").alias("_claims"))
    asked = each.groupBy(*run).agg(F.count("*").alias("questions"))
    return each.join(asked, run).withColumn("_cap", per_question).groupBy(*run).agg(F.sum(F.greatest(F.col("_cap") - F.col("_claims"), F.lit(0))).alias("free"), F.sum("_cap").alias("slots"))


def upper_median(value: str) -> Column:
    """The middle value, the upper one of two: the discrete median from above, which keeps counts by value, not rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def jitter(answers: DataFrame, key: list[str], asked_at: str, before: str, again: str, cut: float, day: str | None = None) -> DataFrame:
    """One row: n, flips, mean and most change between a stored answer and the latest one to the same question; with `day`,
    days, on how many of them these were asked."""
    kept = [before, again, *([day] if day else [])]
    latest = answers.groupBy(*key).agg(F.max_by(F.struct(*kept), asked_at).alias("r"))
    change = F.abs(F.col(f"r.{before}") - F.col(f"r.{again}"))
    flip = (F.col(f"r.{before}") >= cut) != (F.col(f"r.{again}") >= cut)
    days = [F.count_distinct(f"r.{day}").alias("days")] if day else []
    return latest.agg(F.count("*").alias("n"), F.count_if(flip).alias("flips"), F.avg(change).alias("mean_change"), F.max(change).alias("most_change"), *days)


def item_labels(calls: DataFrame, rubrics: DataFrame, positive: tuple[str, ...] = ("yes", "partial")) -> DataFrame:
    """item, answer, positive: the latest answered call of an item under its kind's rubric of today.

    calls: item, kind, at, answer (null: none), rubric. rubrics: kind, rubric, a row a kind.
    """
    today = calls.filter(F.col("answer").isNotNull()).join(F.broadcast(rubrics), ["kind", "rubric"], "left_semi")
    latest = today.groupBy("item").agg(F.max_by("answer", F.struct("at", "answer")).alias("answer"))
    return latest.withColumn("positive", F.col("answer").isin(*positive))


def pooled_difference(days: DataFrame, unit: list[str], now: str, then: str) -> DataFrame:
    """paired_difference() of all lines' days together, each a unit of its own, with the sums of both arms: now, then."""
    rows = days.select(F.concat_ws("|", *unit).alias("unit"), (F.col(then) - F.col(now)).alias("d"))
    sums = days.agg(F.sum(now).alias("now"), F.sum(then).alias("then"))
    return sums.crossJoin(F.broadcast(statistics.paired_difference(rows, "unit", "d")))  # a row each


def weighted_accuracy(df: DataFrame, score: str, gold: str, weight: Column, cut: float, below: bool = False) -> DataFrame:
    """One row: the weighted share of labels that the cut gets right; with `below`, scores under it are the positive ones."""
    positive = F.col(score) < cut if below else F.col(score) >= cut
    right = positive == F.col(gold)
    return df.agg((F.sum(F.when(right, weight).otherwise(0.0)) / F.sum(weight)).alias("accuracy"))


def stuck_stage(steps: DataFrame, key: str, step: str, order: list[str]) -> DataFrame:
    """key and the first of the ordered steps that it has no row of; null if it has all."""
    seen = steps.groupBy(key).agg(*[F.count_if(F.col(step) == s).alias(f"_{i}") for i, s in enumerate(order)])
    first = F.coalesce(*[F.when(F.col(f"_{i}") == 0, F.lit(s)) for i, s in enumerate(order)])
    return seen.select(key, first.alias("stuck_at"))


def bootstrap(diffs: DataFrame, key: str, diff: str, reps: int = 2000, seed: str = "bootstrap", confidence: float = 0.95, bound: int = 100_000) -> DataFrame:
    """mean of the paired differences, low and high of the means of `reps` resamples by hashed places.

    The list is sent to every task; more than `bound` differences are an error.
    """
    if diffs.limit(bound + 1).count() > bound:
        raise ValueError("more differences than are sent to every task")
    listed = diffs.agg(F.transform(F.array_sort(F.collect_list(F.struct(key, diff))), lambda x: x[diff].cast("double")).alias("ds"), F.avg(diff).alias("mean"))
    rounds = diffs.sparkSession.range(reps).withColumnRenamed("id", "rep")
    place = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), i), F.size("ds")) + 1).cast("int")
    total = F.aggregate(F.transform("ds", lambda d, i: F.element_at("ds", place(i))), F.lit(0.0), lambda a, x: a + x)
    tail, order = (1 - confidence) / 2, Window.orderBy("m")  # reps rows
    means = rounds.crossJoin(F.broadcast(listed)).select("mean", (total / F.size("ds")).alias("m")).withColumn("n", F.row_number().over(order) - 1)
    at = lambda share: F.max(F.when(F.col("n") == min(reps - 1, int(share * reps)), F.col("m")))
    return means.agg(F.max("mean").alias("mean"), at(tail).alias("low"), at(1 - tail).alias("high"))


def drift(before: Column, after: Column) -> Column:
    """The greatest change of a probability over the outcomes of an answer (maps from outcome to probability)."""
    change = F.map_zip_with(before, after, lambda _, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))
    return F.array_max(F.map_values(change))


def used_rate(marks: DataFrame, by: list[str]) -> DataFrame:
    """by, a count of each verdict, and rate: used of those decided; null where none is."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    verdicts = ("used", "unused", "pending", "unknown")
    counts = marks.groupBy(*by) if by else marks
    return counts.agg(*[n(v).alias(v) for v in verdicts], F.try_divide(n("used"), n("used") + n("unused")).alias("rate"))


def groups_of_lines(lines: DataFrame, line: str, free: str, slots: str, values: list[str], bound: float = 0.3) -> DataFrame:
    """group (all, slot, supply) and the sums of values: all lines, those whose free share of slots is at most `bound`, and the
    others that have slots. A line counts for each of its groups; what is summed is one row a line."""
    share = F.try_divide(F.col(free), F.col(slots))
    kinds = F.array(F.lit("all"), F.when(share <= bound, "slot").when(share > bound, "supply"))
    each = lines.withColumn("group", F.explode(kinds)).filter("group IS NOT NULL")
    return each.groupBy("group").agg(F.count(line).alias("lines"), *[F.sum(v).alias(v) for v in values])


def reasons(rows: DataFrame, reason: str) -> DataFrame:
    """reason, n, place: the most frequent first, then by text."""
    counts = rows.groupBy(reason).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), reason)))  # one row a reason


def self_check(replayed: DataFrame, recorded: DataFrame, day: str, key: list[str]) -> DataFrame:
    """day, missed (recorded, not replayed), extra (replayed, not recorded)."""
    a, b = replayed.select(day, *key).distinct().withColumn("_a", F.lit(1)), recorded.select(day, *key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, [day, *key], "full")
    return both.groupBy(day).agg(F.count_if(F.col("_a").isNull()).alias("missed"), F.count_if(F.col("_b").isNull()).alias("extra"))


def rotation_estimate(yields: DataFrame, query: str, order: str, fresh: str, now: DataFrame, then: DataFrame, runs: int, keep: int = 5) -> DataFrame:
    """One row that compares two arms' sends: now, then (finds a run: sends a run times the mean yield of a query's last
    `keep` sends), change with low and high, freed (sends a run fewer), missing_now and missing_then (queries that are sent
    but have no yields).

    now, then: query, sends (over all runs; each query once). The variance takes yields for counts of chance, with half a
    find more so that none found isn't certain, and only what the arms send differently has any.
    """
    last = yields.filter(F.col(fresh).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(order)))).filter(F.col("_r") <= keep)
    known = last.groupBy(query).agg(F.sum(fresh).alias("_sum"), F.count("*").alias("_n"))
    both = now.select(query, F.col("sends").alias("_a")).join(then.select(query, F.col("sends").alias("_b")), query, "full").na.fill(0, ["_a", "_b"])
    each = both.join(known, query, "left")
    a, b, mean = F.col("_a") / runs, F.col("_b") / runs, F.coalesce(F.col("_sum") / F.col("_n"), F.lit(0.0))
    spread = F.coalesce(F.pow((b - a) / F.col("_n"), F.lit(2.0)) * (F.col("_sum") + 0.5), F.lit(0.0))
    missing = lambda sends: F.count_if(F.col("_n").isNull() & (sends > 0))
    found = each.agg(F.sum(a * mean).alias("now"), F.sum(b * mean).alias("then"), F.sum(spread).alias("_v"), F.sum(a - b).alias("freed"), missing(a).alias("missing_now"), missing(b).alias("missing_then"))
    change, half = F.col("then") - F.col("now"), statistics.Z95 * F.sqrt("_v")
    return found.select("now", "then", change.alias("change"), (change - half).alias("low"), (change + half).alias("high"), "freed", "missing_now", "missing_then")


def boundary(found: DataFrame, key: str, arm: str, p: str, cut: float, within: float = 0.1) -> DataFrame:
    """key, arm, best: what only one arm found, by its greatest probability, where that is below cut + within."""
    each = found.groupBy(key).agg(F.max(p).alias("best"), F.min(arm).alias("arm"), F.max(arm).alias("_other"))
    return each.filter((F.col("arm") == F.col("_other")) & (F.col("best") < cut + within)).select(key, "arm", "best")


def delays(found: DataFrame, first: str, seen: str) -> DataFrame:
    """One row: median days from what was first possible to what was, and how many came late."""
    d = F.datediff(first, seen)
    return found.agg(F.median(d).alias("median_days"), F.count_if(d > 0).alias("late"))


def axis_meters(judged: DataFrame, key: list[str], order: list[Column], axes: dict[str, Column]) -> DataFrame:
    """axis, mean_score: the mean position on each axis over the latest judgment of each key; null where none has one.

    Every axis has its row, also over an empty table.
    """
    last = windows.latest(judged, key, *order)
    means = last.agg(*[F.avg(c).alias(f"_{n}") for n, c in enumerate(axes.values())])
    rows = F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(f"_{n}").alias("mean_score")) for n, axis in enumerate(axes)])
    return means.select(F.inline(rows))


def tallies(tried: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """by, hit, tried: how many rows were tried and how many hit; a null hit is none."""
    return tried.groupBy(*by).agg(F.count_if(hit).alias("hit"), F.count("*").alias("tried"))


def same_sets(replayed: DataFrame, recorded: DataFrame, group: list[str], item: str) -> DataFrame:
    """group, same: whether both sides have the same items of a group. A null item only states that the group is there."""
    sides = [df.select(*group, F.col(item).alias("_item"), F.lit(side).alias("_side")) for side, df in ((1, replayed), (2, recorded))]
    found = sides[0].unionByName(sides[1]).groupBy(*group, "_item").agg(F.count_distinct("_side").alias("_sides"))
    return found.groupBy(*group).agg((F.count_if(F.col("_item").isNotNull() & (F.col("_sides") < 2)) == 0).alias("same"))
