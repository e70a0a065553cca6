"""Replay of what an intake would have reached day by day: listings cut, other nets, and free slots filled from earlier days."""

from __future__ import annotations

import datetime as dt
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import Arm, listing_cut

LISTINGS, BACKLOG = "firehose", "backlog"
#: The order in which a day's listings are read.
READ_FIRST = ("hf_papers", "arxiv")
#: The listing whose earlier days fill free slots.
REFILLED = "arxiv"


def by_listing(fetched: DataFrame) -> Column:
    """A listing's place among a day's."""
    out = F.lit(len(READ_FIRST))
    for i, adapter in enumerate(READ_FIRST):
        out = F.when(F.col("adapter") == adapter, i).otherwise(out)
    return out


def without_backlog(fetched: DataFrame, arm: Arm) -> tuple[DataFrame, DataFrame]:
    """What a day reaches by itself: its listings' cut, with slot, and what the arm's other nets bring; line, day, source, via."""
    listings = fetched.filter(F.col("net") == LISTINGS)
    ranked = F.when(F.col("adapter") == REFILLED, F.col("score"))
    listed = listings.select("line", "day", "source", F.struct(by_listing(fetched).alias("rank"), F.col("place").alias("fetch")).alias("rank"), ranked.alias("score"), F.col("pos").alias("place"), "via")
    cut = listing_cut(listed, arm, "line", "day")
    first = listed.groupBy("line", "day", "source").agg(F.min_by("via", F.struct("rank", "place")).alias("via"))
    kept = cut.join(first, ["line", "day", "source"])
    others = fetched.filter((F.col("net") != LISTINGS) & arm.sends(F.col("net"), F.col("query"))).select("line", "day", "source", "via").distinct()
    return (kept.limit(0) if LISTINGS in arm.off else kept), others


def fill(room: int, window: deque, taken: set, day: dt.date) -> list:
    """The sources that free slots take of earlier days' listings, the newest first; by score where not all fit and any has one."""
    pool: dict = {}
    for _, rows in reversed(window):
        for source, score, reached in rows:
            if source not in taken and source not in pool and (reached is None or reached > day):
                pool[source] = score
    found = list(pool)
    if len(found) > room and any(s is not None for s in pool.values()):
        found.sort(key=lambda s: float("inf") if pool[s] is None else -pool[s])
    return found[:room]


def backlog(fetched: DataFrame, days: DataFrame, arm: Arm, kept: DataFrame, others: DataFrame, back: int, start: dt.date) -> DataFrame:
    """line, day, source of free slots, filled from the listings of the `back` days before.

    Only what a day leaves over is carried on: a listed source that is reached without the backlog on its day, or before, never
    fills a slot, and is dropped before the fold. A line's days lie one behind the other in one task, which holds the listings
    of `back` days and what it has taken (as many as there were free slots) and no more.
    """
    base = kept.select("line", "day", "source").unionByName(others.select("line", "day", "source")).groupBy("line", "source").agg(F.min("day").alias("reached"))
    fine = (F.col("net") == LISTINGS) & (F.col("adapter") == REFILLED) & arm.screenable(F.col("chars"))
    # before the window of the replay, what was judged then was taken then
    fresh = (F.col("day") >= F.lit(start)) | F.coalesce(F.col("judged_on") >= F.lit(start), F.lit(True))
    left = fetched.filter(fine & fresh).join(base, ["line", "source"], "left").filter(F.col("reached").isNull() | (F.col("reached") > F.col("day")))
    candidates = left.select("line", "day", F.lit(1).alias("kind"), "place", "pos", "source", "score", "reached", F.lit(0).alias("room"))
    used = kept.groupBy("line", "day").agg(F.count("*").alias("used"))
    lines = fetched.select("line").distinct().crossJoin(F.broadcast(days.select("day").distinct()))  # a row a line and day
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(fetched.dtypes)
    rooms = lines.join(used, ["line", "day"], "left").select("line", "day", F.lit(0).alias("kind"), none(kinds["place"]).alias("place"), none(kinds["pos"]).alias("pos"), none(kinds["source"]).alias("source"), none("double").alias("score"), none("date").alias("reached"), (arm.cap - F.coalesce("used", F.lit(0))).cast("int").alias("room"))
    rows = candidates.unionByName(rooms).repartition("line").sortWithinPartitions("line", "day", "kind", "place", "pos", "source")
    schema = fetched.select("line", "day", "source").schema
    arrow = [c for c in ("line", "day", "kind", "source", "score", "reached", "room")]

    def run(batches):
        line, window, taken, out = object(), deque(), set(), []
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(n).type for n in ("line", "day", "source")]
            for at, day, kind, source, score, reached, room in zip(*[batch.column(n).to_pylist() for n in arrow]):
                if at != line:
                    line, window, taken = at, deque(), set()
                while window and (day - window[0][0]).days > back:
                    window.popleft()
                if kind:
                    if not window or window[-1][0] != day:
                        window.append((day, []))
                    window[-1][1].append((source, score, reached))
                elif room > 0:
                    found = fill(room, window, taken, day)
                    taken.update(found)
                    out += [(at, day, s) for s in found]
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), kinds)], names=["line", "day", "source"])

    return rows.select(*arrow).mapInArrow(run, schema)


def replay(fetched: DataFrame, days: DataFrame, arm: Arm, back: int = 0, start: dt.date = dt.date.min) -> DataFrame:
    """line, day, source, via of everything that a configuration reaches on the given days.

    fetched: line, day, net, adapter, query, via, place (of the request in its day), pos (of the source in its reply), source,
    score (of a listed source against the line's query; null where listings aren't ranked), chars, judged_on. days: day.
    A day's listings fill the arm's slots first (see listing_cut); with `back`, what is left of them goes to sources of the
    listings of so many days before that nothing else brings, each once.
    """
    kept, others = without_backlog(fetched.join(F.broadcast(days.select("day").distinct()), "day", "left_semi"), arm)
    out = kept.select("line", "day", "source", "via").unionByName(others)
    if back and LISTINGS not in arm.off:
        out = out.unionByName(backlog(fetched, days, arm, kept, others, back, start).withColumn("via", F.lit(BACKLOG)))
    return out.distinct()
