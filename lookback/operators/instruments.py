"""A registry of measurements: what each instrument read on a day, beside what it must agree with, and whether to trust it.

Every table gives facts by (scope, line, day); all facts meet in one grouping, so that each table is read once, whatever the
number of instruments, and an instrument is a few expressions over the grouped row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import citations
from . import health
from .windows import with_streak

#: Scopes: a line's run on a day, and a day's tick of all lines (whose line is TICK).
RUN, TICK = "run", "tick"
# Stages whose outputs are counted.
ARXIV, DAILY, CITING = "fetch_firehose_arxiv", "fetch_firehose_hf_papers", "fetch_citation_openalex"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Instrument:
    """value (null: missing), related, at and conflict are expressions over a grouped row; cell says whether there is a reading.

    expect: zero, positive, agrees or any (see health.reading_status), an expression over value, related, at. part: which part
    of the review it stands for. stuck_after: so many equal live values in a row are suspect. since: the first day that counts.
    review_by: until then a zero is declared to be right.
    """

    id: str
    part: str
    scope: str
    value: Column
    cell: Column = field(default_factory=lambda: F.lit(True))
    related: Column = field(default_factory=lambda: _none("long"))
    at: Column = field(default_factory=lambda: _none("timestamp"))
    conflict: Column = field(default_factory=lambda: _none("string"))
    expect: Column = field(default_factory=lambda: F.lit("any"))
    stuck_after: int | None = None
    since: str | None = None
    review_by: str | None = None


# facts of each table


def run_facts(runs: DataFrame) -> DataFrame:
    """runs: line, day, started_at (null: known by its report alone), report (null: none), budget, writer_calls, tokens,
    questions, claims (counts of the report). A run is also a tick of its day."""
    scopes = F.explode(F.array(F.lit(RUN), F.lit(TICK)))
    each = runs.select("*", scopes.alias("scope"))
    line = F.when(F.col("scope") == RUN, F.col("line").cast("string")).otherwise(TICK)
    facts = {n: F.when(F.col("scope") == RUN, F.col(n)) for n in ("started_at", "budget", "writer_calls", "tokens", "questions", "claims")}
    reported = F.when(F.col("scope") == RUN, F.col("report").isNotNull())
    return each.select("scope", line.alias("line"), "day", F.lit(True).alias("ran"), reported.alias("reported"), *[c.alias(n) for n, c in facts.items()])


def stage_facts(stages: DataFrame) -> DataFrame:
    """stages: line, stage, completed_at, outputs. One row a record, with its count of outputs in the column of its stage."""
    out, size = [], F.size("outputs").cast("long")
    for name, stage in (("arxiv", ARXIV), ("daily", DAILY), ("citing", CITING)):
        own = F.col("stage") == stage
        out += [F.when(own, size).alias(name), F.when(own, F.col("completed_at")).alias(f"{name}_at")]
    return stages.filter(F.col("stage").isin(ARXIV, DAILY, CITING)).select(F.lit(RUN).alias("scope"), F.col("line").cast("string").alias("line"), F.to_date("completed_at").alias("day"), *out)


def log_facts(logs: DataFrame, claim_sources: DataFrame) -> DataFrame:
    """logs: line, day, log, logged_at, text, claims. When each section was written, which sources a line cites for the first
    time, and which [n] mean no source.

    A log becomes a row of its own and one for each [n] that it cites; rows of a source are grouped to its line's first day.
    """
    n = F.lit(None).cast("long")
    own = F.struct(n.alias("n"), _none("string").alias("claim"))
    claim = lambda k: F.when(k.between(1, F.size("claims")), F.try_element_at("claims", k.cast("int")))
    cited = F.transform(citations(F.col("text")), lambda k: F.struct(k.alias("n"), claim(k).alias("claim")))
    rows = logs.select(F.col("line").cast("string").alias("line"), "day", F.col("log").cast("string").alias("log"), "logged_at", (F.trim("text") != "").alias("_written"), F.explode(F.concat(F.array(own), cited)).alias("c"))
    rows = rows.select("*", "c.n", "c.claim").join(claim_sources.select("claim", "source").dropDuplicates(["claim"]), "claim", "left")
    kind = F.when(F.col("n").isNull(), "log").when(F.col("source").isNull(), "broken").otherwise("source")
    key = F.when(F.col("n").isNotNull() & F.col("source").isNotNull(), F.col("source").cast("string")).otherwise(F.concat_ws(" ", "log", F.col("n").cast("string")))
    first = rows.groupBy("line", kind.alias("kind"), key.alias("key")).agg(F.min("day").alias("day"), F.min(F.when(F.col("_written"), F.col("logged_at"))).alias("logged_at"), F.min(F.struct("log", "n")).alias("at"))
    broken = F.when(F.col("kind") == "broken", F.struct(F.col("at.log").alias("log"), F.col("at.n").alias("n")))
    return first.select(F.lit(RUN).alias("scope"), "line", "day", F.when(F.col("kind") == "log", F.col("logged_at")).alias("logged"), F.when(F.col("kind") == "source", F.lit(1)).cast("long").alias("first_cited"), broken.alias("broken"))


def label_facts(labels: DataFrame, since: str) -> DataFrame:
    """labels: label, harvested_at, first_harvested_at, written (day of the note). A label counts on the day it was first
    harvested; what can't be so is a conflict on the day of its latest harvest."""
    first, last = F.col("first_harvested_at"), F.col("harvested_at")
    why = F.when(first.isNull(), F.when(F.col("written") >= F.lit(since).cast("date"), "no first harvest on a note written since it is kept"))
    why = why.when(first > last, "first harvest after the latest harvest").when(F.to_date(first) < F.col("written"), "first harvest before its note was written")
    counted = F.struct(F.to_date(first).alias("day"), F.lit(1).cast("long").alias("harvested"), _none("string").alias("unharvested"))
    wrong = F.struct(F.to_date(last).alias("day"), F.lit(0).cast("long").alias("harvested"), F.concat(F.col("label").cast("string"), F.lit(": "), why).alias("unharvested"))
    rows = labels.select(F.explode(F.array(F.when(first.isNotNull(), counted), F.when(why.isNotNull(), wrong))).alias("f")).filter("f IS NOT NULL")
    return rows.select(F.lit(TICK).alias("scope"), F.lit(TICK).alias("line"), "f.*", F.lit(True).alias("ticked"))


def opened_facts(opened: DataFrame, pattern: str) -> DataFrame:
    """opened: note, day. Notes of lines, by a pattern, first seen open on a day; a note's own date is its beginning."""
    early = F.col("day") < F.try_to_date(F.left("note", F.lit(10)), "yyyy-MM-dd")
    return opened.filter(F.rlike("note", F.lit(pattern))).select(F.lit(TICK).alias("scope"), F.lit(TICK).alias("line"), "day", F.lit(1).cast("long").alias("opened"), F.when(early, F.concat("note", F.lit(" seen opened on "), F.col("day").cast("string"), F.lit(", before its own date"))).alias("too_early"), F.lit(True).alias("ticked"))


def sighting_facts(sightings: DataFrame) -> DataFrame:
    """sightings: first_seen, place. Those in the notes' own folders."""
    own = (F.col("place") == "vault") | F.startswith("place", F.lit("vault:"))
    return sightings.filter(own).select(F.lit(TICK).alias("scope"), F.lit(TICK).alias("line"), F.col("first_seen").alias("day"), F.lit(1).cast("long").alias("sighted"), F.lit(True).alias("ticked"))


#: How facts of one (scope, line, day) are put together.
MEETING = {
    "ran": F.max, "reported": F.max, "ticked": F.max, "started_at": F.max, "budget": F.max, "writer_calls": F.max, "tokens": F.max, "questions": F.max, "claims": F.max,
    "arxiv": F.sum, "arxiv_at": F.min, "daily": F.sum, "daily_at": F.min, "citing": F.sum, "citing_at": F.min,
    "logged": F.collect_list, "first_cited": F.sum, "broken": F.min, "harvested": F.sum, "unharvested": F.min, "opened": F.sum, "too_early": F.min, "sighted": F.sum,
}


def grouped(facts: list[DataFrame]) -> DataFrame:
    """One row a (scope, line, day) that a run or a tick has, with what the instruments read.

    logged lists the times of a run's sections, which are as many as its questions.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    rows = every.groupBy("scope", "line", "day").agg(*[f(n).alias(n) for n, f in MEETING.items()]).filter(F.col("ran") | F.col("ticked"))
    counted = F.when(F.col("reported"), F.coalesce("first_cited", F.lit(0)))
    before = Window.partitionBy("scope", "line").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"first_cited": counted, "written": F.size(F.filter("logged", lambda t: t == F.col("started_at"))).cast("long")})
    return rows.withColumns({"previous_cited": F.last("first_cited", True).over(before), "previous_claims": F.last(F.when(F.col("reported"), F.col("claims")), True).over(before)})


def registry(holidays: list[str], since: str, review_by: str) -> list[Instrument]:
    """The ten instruments of a review."""
    c = F.col
    reported, run = c("reported"), c("ran")
    agrees = F.when(F.coalesce(c("related"), F.lit(0)) > 0, "agrees").otherwise("any")
    not_twice = F.when(c("related") == 0, "positive").otherwise("any")
    quiet = lambda q: F.when(c("at").isNotNull() & q, "zero").otherwise("positive")
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    broken = F.concat(c("broken.log"), F.lit(" ["), c("broken.n").cast("string"), F.lit("] resolves to no source"))
    return [
        Instrument("firehose.arxiv", "I", RUN, c("arxiv"), run & (c("budget") >= 1), at=c("arxiv_at"), expect=quiet(health.listing_quiet(c("at"), holidays)), stuck_after=3),
        Instrument("firehose.hf", "I", RUN, c("daily"), run & (c("budget") >= 2), at=c("daily_at"), expect=quiet(health.daily_quiet(c("at")))),
        Instrument("citation", "I", RUN, c("citing"), run & c("citing").isNotNull(), at=c("citing_at"), review_by=review_by),
        Instrument("used.vault", "OUT", TICK, zero("sighted"), run | c("sighted").isNotNull(), since=since, review_by=review_by),
        Instrument("writer_calls", "D", RUN, F.when(reported, c("writer_calls")), run & c("started_at").isNotNull(), related=F.when(reported, c("written")), expect=agrees, since=since),
        Instrument("judge_tokens", "D", RUN, F.when(reported, c("tokens")), run, related=F.when(reported, c("questions")), expect=agrees, since=since, stuck_after=3),
        Instrument("o1", "OUT", RUN, c("first_cited"), run, related=F.when(reported, c("previous_cited")), conflict=F.when(reported, broken), expect=not_twice),
        Instrument("claims_posted", "X", RUN, F.when(reported, c("claims")), run, related=F.when(reported, c("previous_claims")), expect=not_twice),
        Instrument("label.first_harvest", "M", TICK, zero("harvested"), run | c("harvested").isNotNull(), conflict=c("unharvested"), since=since),
        Instrument("opened", "M", TICK, zero("opened"), run | c("opened").isNotNull(), conflict=c("too_early"), since=since),
    ]


def readings(rows: DataFrame, instruments: list[Instrument]) -> DataFrame:
    """instrument, part, line, day, value, related, at, conflict, expect, status of every instrument's cells, all from grouped()."""
    each = []
    for i in instruments:
        fits = (F.col("scope") == i.scope) & i.cell & (F.lit(True) if i.since is None else F.col("day") >= F.lit(i.since).cast("date"))
        fields = [F.lit(i.id).alias("instrument"), F.lit(i.part).alias("part"), i.value.cast("long").alias("value"), i.related.cast("long").alias("related"), i.at.cast("timestamp").alias("at"), i.conflict.alias("conflict"), F.lit(i.stuck_after).cast("int").alias("stuck_after"), F.lit(i.review_by).cast("date").alias("review_by")]
        each.append(F.when(fits, F.struct(*fields)))
    cells = rows.select("line", "day", F.explode(F.array(*each)).alias("i")).filter("i IS NOT NULL").select("line", "day", "i.*")
    expect = F.lit("any")
    for i in instruments:
        expect = F.when(F.col("instrument") == i.id, i.expect).otherwise(expect)
    cells = cells.withColumn("expect", expect)
    cells = cells.withColumn("status", health.reading_status(F.col("value"), F.col("conflict"), F.col("expect"), F.col("day"), F.col("review_by")))
    ran = with_streak(cells, ["instrument", "line"], "day", "value", F.col("status") == "live", "_streak")
    stuck = F.coalesce(F.col("_streak") >= F.col("stuck_after"), F.lit(False)) & (F.col("status") == "live")
    return ran.withColumn("status", F.when(stuck, "stuck").otherwise(F.col("status"))).drop("_streak", "stuck_after", "review_by")
