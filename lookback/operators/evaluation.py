"""What a candidate would have shown or reached beside what is in use: entries, days, intake."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics
from .routing import Policy, detection, gates, route, weighted
from .windows import capped, claims_per_question


def best_screens(screens: DataFrame, key: list[str], policy: Policy) -> DataFrame:
    """key, route (keep before review before drop) over the pair's screenings, and best: the greatest score of one whose gates pass.

    screens: key, on_topic, method, evidence, overlap, strength, novelty, sure (the least certainty of the answers).
    """
    c = F.col
    score = weighted(c("overlap"), c("strength"), c("novelty"))
    passes = gates(c("on_topic"), c("method"), c("evidence"), policy)
    rank = F.when(route(F.lit(False), F.lit(True), passes, score, c("sure"), policy) == "keep", 2)
    rank = rank.when(route(F.lit(False), F.lit(True), passes, score, c("sure"), policy) == "review", 1).otherwise(0)
    best = screens.groupBy(*key).agg(F.max(rank).alias("_r"), F.max(F.when(passes, score)).alias("best"))
    return best.select(*key, F.element_at(F.array(*map(F.lit, ("drop", "review", "keep"))), F.col("_r") + 1).alias("route"), "best")


def with_scores(entries: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """Adds score, the lesser of bearing on the question and being checkable, and what newness needs: known to question or line.

    First days by (question, key) and (line, key) are broadcast while they are at most `bound`, joined beyond.
    """

    def firsts(*key: str) -> DataFrame:
        found = entries.groupBy(*key).agg(F.min("day").alias(f"_first_{key[0]}"))
        return F.broadcast(found) if found.limit(bound + 1).count() <= bound else found

    out = entries.join(firsts("question", "key"), ["question", "key"]).join(firsts("line", "key"), ["line", "key"])
    bears = F.col("p_advances") + F.col("p_contradicts")
    known = {f"known_to_{k}": F.col(f"_first_{k}") < F.col("day") for k in ("question", "line")}
    return out.withColumns(known | {"score": F.least(bears, F.col("p_checkable"))}).drop("_first_question", "_first_line")


def in_pool(policy: Policy) -> Column:
    """Whether an entry passes detection and novelty; a missing answer never does."""
    c = F.col
    answered = c("p_advances").isNotNull() & c("p_contradicts").isNotNull() & c("p_checkable").isNotNull()
    found = detection(c("p_advances"), c("p_contradicts"), c("p_checkable"), policy)
    return F.coalesce(answered & found["accept"] & (c("novelty") >= policy.novelty), F.lit(False))


def slot_order(new_first: bool) -> list[Column]:
    return [*([F.asc("known_to_question")] if new_first else []), F.desc("score"), F.asc("item")]


def shown(entries: DataFrame, policy: Policy, new_first: bool = False) -> DataFrame:
    """The entries that a day's note shows: those that pass detection and novelty, capped by question and source.

    entries: day, line, question, source, item, key, p_advances, p_contradicts, p_checkable, novelty, score,
    known_to_question (see with_scores).
    """
    pool = entries.filter(in_pool(policy))
    asked = pool.groupBy("line", "day").agg(F.count_distinct("question").alias("_n"))
    pool = pool.join(asked, ["line", "day"]).withColumn("_day", F.struct("line", "day", "question"))
    return capped(pool, "_day", "source", *slot_order(new_first), per_question=claims_per_question(F.col("_n"))).drop("_day", "_n", "place")


def with_shown(entries: DataFrame, policies: dict[str, tuple[Policy, bool]]) -> DataFrame:
    """All entries with pool_<name> and shown_<name> (see shown()) of every named policy and slot order.

    All windows are within a line's day, by which the entries are dealt out once, whatever the number of policies.
    """
    day, out = ["line", "day"], entries.repartition("line", "day")
    for name, (policy, new_first) in policies.items():
        order, pool = slot_order(new_first), F.col(f"pool_{name}")
        out = out.withColumn(f"pool_{name}", in_pool(policy))
        asked = F.size(F.collect_set(F.when(pool, F.col("question"))).over(Window.partitionBy(*day)))
        of_source = F.row_number().over(Window.partitionBy(*day, "question", "source").orderBy(F.desc(pool), *order))
        out = out.withColumn("_n", asked).withColumn("_few", pool & (of_source <= 2))
        of_question = F.row_number().over(Window.partitionBy(*day, "question").orderBy(F.desc("_few"), *order))
        out = out.withColumn(f"shown_{name}", F.col("_few") & (of_question <= claims_per_question(F.col("_n")))).drop("_n", "_few")
    return out


def shown_score(entries: DataFrame, now: tuple[Policy, bool], then: tuple[Policy, bool]) -> DataFrame:
    """One row: days, shown, new and newq of both policies (with their slot orders), better and worse (line-days with more
    or fewer keys new to the line)."""
    marked = with_shown(entries, {"now": now, "then": then})
    counts = []
    for p in ("now", "then"):
        seen, paper = F.col(f"shown_{p}"), F.struct("question", "key")
        counts += [F.count_if(seen).alias(f"shown_{p}"), F.count_distinct(F.when(seen & ~F.col("known_to_line"), F.col("key"))).alias(f"new_{p}"), F.count_distinct(F.when(seen & ~F.col("known_to_question"), paper)).alias(f"newq_{p}")]
    both = marked.groupBy("line", "day").agg(*counts)
    change = F.col("new_then") - F.col("new_now")
    totals = [F.sum(f"{k}_{p}").alias(f"{k}_{p}") for k in ("shown", "new", "newq") for p in ("now", "then")]
    return both.agg(F.count("*").alias("days"), *totals, F.count_if(change > 0).alias("better"), F.count_if(change < 0).alias("worse"))


def strata(entries: DataFrame, of: list[str], policy: Policy) -> DataFrame:
    """One row for each `of`: stratum on the first day it is an entry: shown, cut (in the pool, but not shown), dup (not in it)."""
    marked = with_shown(entries, {"now": (policy, False)})
    days = marked.groupBy(*of, "day").agg(F.max("shown_now").alias("s"), F.max("pool_now").alias("p"))
    first = days.groupBy(*of).agg(F.min_by(F.struct("s", "p"), "day").alias("f"))
    return first.select(*of, F.when(F.col("f.s"), "shown").when(F.col("f.p"), "cut").otherwise("dup").alias("stratum"))


#: How likely a pair must be for the prefilter to have been near its cut, and the bands of the best score.
NEAR, BANDS = 0.3, ((0.7, "high"), (0.6, "band-high"), (0.5, "band-low"))


def band(outcome: Column, on_topic: Column, best: Column) -> Column:
    """A pair's stratum: how far it came (see routing.staged_outcome), and by its best score, null if no screening's gates pass."""
    out = F.when(outcome == "prefilter", F.when(on_topic >= NEAR, "pf-near").otherwise("pf-far")).when(outcome.isin("safe", "unasked"), outcome).when(best.isNull(), "gate")
    for cut, name in BANDS:
        out = out.when(best >= cut, name)
    return out.otherwise("low")


@dataclass(frozen=True)
class Arm:
    """A configuration of the intake: slots of a day's listings, nets that are off, queries dropped, the shortest text."""

    cap: int
    off: tuple[str, ...] = ()
    dropped: tuple[str, ...] = ()
    least_chars: int = 200

    def sends(self, net: Column, query: Column) -> Column:
        keep = F.lit(True)
        if self.off:
            keep = keep & ~net.isin(*self.off)
        return keep & ~F.coalesce(query.isin(*self.dropped), F.lit(False)) if self.dropped else keep

    def screenable(self, chars: Column) -> Column:
        return chars >= self.least_chars


def listing_cut(listed: DataFrame, arm: Arm, *day: str) -> DataFrame:
    """What a day's listings keep in the arm's slots: by order of the listing (rank), then by score, the best first, then by place.

    listed: day, source, rank, score (null where a listing isn't ranked), place. A source of several listings counts once.
    """
    once = listed.groupBy(*day, "source").agg(F.min(F.struct("rank", (-F.coalesce("score", F.lit(0.0))).alias("s"), "place")).alias("_o"))
    order = Window.partitionBy(*day).orderBy("_o", "source")
    return once.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= arm.cap).select(*day, "source", "slot")


def source_verdict(p: Column, cut: float = 0.5) -> Column:
    """struct(passes, best, margin) of the probabilities of a source's questions."""
    best = F.array_max(p)
    return F.struct((best >= cut).alias("passes"), best.alias("best"), F.abs(best - cut).alias("margin"))


def new_finds(reached: DataFrame, known: DataFrame) -> DataFrame:
    """key, first_day, vias of what passed and wasn't known: reached has day, source, via, key, chars_ok, passes (null: unjudged)."""
    fresh = reached.filter("chars_ok AND passes").join(known.select("key").distinct(), "key", "left_anti")
    return fresh.groupBy("key").agg(F.min("day").alias("first_day"), F.array_sort(F.collect_set("via")).alias("vias"))


def intake_score(reached: DataFrame, known: DataFrame) -> DataFrame:
    """One row: reached and screened sources, unjudged ones, keys, new keys, new keys that passed; days, passed_a_day; delay
    (median days from a passed key's publication to the day it was first reached); once and twice (passed new keys that one,
    two days found) with Chao2's estimate of all there are, null below 10 days.

    reached: day, source, key, chars_ok, passes (null: unjudged), published (null: unknown).
    """
    fresh = reached.join(known.select("key").distinct().withColumn("_known", F.lit(True)), "key", "left")
    new = F.col("_known").isNull()
    found = new & F.col("chars_ok") & F.coalesce("passes", F.lit(False))
    totals = fresh.agg(
        F.count_distinct("source").alias("reached"), F.count_distinct(F.when(F.col("chars_ok"), F.col("source"))).alias("screened"),
        F.count_distinct(F.when(F.col("chars_ok") & F.col("passes").isNull(), F.col("source"))).alias("unjudged"), F.count_distinct("key").alias("keys"),
        F.count_distinct(F.when(new, F.col("key"))).alias("keys_new"), F.count_distinct("day").alias("days"),
    )
    each = fresh.filter(found).groupBy("key").agg(F.count_distinct("day").alias("_units"), F.datediff(F.min("day"), F.min("published")).alias("_delay"))
    passed = each.agg(F.count("*").alias("passed_new"), F.median("_delay").alias("delay"), F.count_if(F.col("_units") == 1).alias("once"), F.count_if(F.col("_units") == 2).alias("twice"))
    both = totals.crossJoin(F.broadcast(passed))  # a row each
    chao = statistics.chao2(F.col("passed_new"), F.col("once"), F.col("twice"), F.col("days"))
    return both.withColumns({"passed_a_day": F.col("passed_new") / F.col("days"), "chao2": F.when(F.col("days") >= 10, chao["estimate"])})


def token_batches(items: DataFrame, group: list[str], order: str, size: str, most: int, fixed: int = 0, most_items: int | None = None) -> DataFrame:
    """items with batch (from 0): each is filled in order until the next item wouldn't fit into `most` with the fixed part, or
    it has most_items; an item too large for any goes alone.

    Where a batch starts depends on the one before, so a group is one fold over its sizes, in one task, of which a task holds
    no more than the running batch; groups are dealt over tasks. Only group, order and size go through it.
    """
    import pyarrow as pa

    room = most - fixed
    narrow = items.select(*group, order, size).repartition(*group).sortWithinPartitions(*group, order)
    schema, k = narrow.select("*").schema.add("batch", "integer"), len(group)

    def fold(batches):
        at, batch, used, n = None, 0, 0, 0
        for rows in batches:
            out = []
            keys, sizes = zip(*[c.to_pylist() for c in rows.columns[:k]]), [n or 0 for n in rows.column(k + 1).to_pylist()]
            for key, tokens in zip(keys, sizes):
                if key != at:
                    at, batch, used, n = key, 0, 0, 0
                elif n and (used + tokens > room or n == most_items):
                    batch, used, n = batch + 1, 0, 0
                used, n = used + tokens, n + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int32())], names=[*rows.schema.names, "batch"])

    return items.join(narrow.mapInArrow(fold, schema).drop(size), [*group, order])


def request_plan(requests: DataFrame, net: str, order: str, budgets: dict[str, int]) -> DataFrame:
    """The requests within each net's budget, in order; nets without a budget send none."""
    allowed = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col(net))
    return requests.withColumn("turn", F.row_number().over(Window.partitionBy(net).orderBy(order))).filter(F.coalesce(F.col("turn") <= allowed, F.lit(False)))


def nearest_reviews(reviews: DataFrame, source: str, question: str, distance: str, most: int = 10) -> DataFrame:
    """The reviews nearest the cut, of each source its nearest question, `most` in all."""
    best = reviews.groupBy(source).agg(F.min(F.struct(distance, question)).alias("r")).select(source, "r.*")
    return best.orderBy(distance, source).limit(most)
