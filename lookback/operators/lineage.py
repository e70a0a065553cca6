"""From citations and labels back to the claims, units and sources that they mean.

Tables: claim_sources has claim, unit, source (see claim_sources); logs has question, day, claims (a list) and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.keys import citations


def claim_sources(claims: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """claim, unit, source of each claim whose unit and source are there."""
    return claims.select("claim", "unit").join(units.select("unit", "source"), "unit").join(sources.select("source"), "source").select("claim", "unit", "source")


def cited_sources(logs: DataFrame, of_claims: DataFrame) -> DataFrame:
    """question, day, n, claim, source of each citation [n] of a log that names one of its claims; source is null if that has none."""
    cites = logs.select("question", "day", "claims", F.explode(citations(F.col("text"))).alias("n"))
    named = cites.select("question", "day", "n", F.when(F.col("n").between(1, F.size("claims")), F.try_element_at("claims", F.col("n").cast("int"))).alias("claim"))
    return named.filter("claim IS NOT NULL").join(of_claims.select("claim", "source"), "claim", "left").select("question", "day", "n", "claim", "source")


def first_unresolved(cited: DataFrame) -> DataFrame:
    """day and the first citation of the day (by question and n) whose claim has no source."""
    return cited.filter("source IS NULL").groupBy("day").agg(F.min(F.struct("question", "n", "claim")).alias("r")).select("day", "r.*")


def posts(logs: DataFrame, of_claims: DataFrame) -> DataFrame:
    """question, day, place (from 1), claim, source of every claim of a log that has a source."""
    each = logs.select("question", "day", F.posexplode("claims").alias("_p", "claim"))
    return each.join(of_claims.select("claim", "source"), "claim").select("question", "day", (F.col("_p") + 1).alias("place"), "claim", "source")


def cited_counts(logs: DataFrame, *by: str) -> DataFrame:
    """by and cited: different [n] of each log, summed."""
    return logs.groupBy(*by).agg(F.sum(F.size(citations(F.col("text")))).alias("cited"))


def judged_claims(judgments: DataFrame, of_claims: DataFrame) -> DataFrame:
    """judgment and each claim that it is about: kind is source, unit or claim, subject one of those."""
    about = lambda kind: judgments.filter(F.col("kind") == kind).select("judgment", F.col("subject").alias(kind))
    found = [about(kind).join(of_claims, kind).select("judgment", "claim") for kind in ("source", "unit")]
    return found[0].unionByName(found[1]).unionByName(about("claim").select("judgment", "claim")).distinct()


def propagated_labels(ticks: DataFrame, logs: DataFrame) -> DataFrame:
    """report, subject, verdict, provenance: a label for each subject that a report's ticks mean.

    ticks: report, kind (qday, source or claim), subject, verdict, place (in the note). logs: log, claims, sources. The tick
    of a question day (subject: its log) goes to the log and to the claims and sources that it holds; a report's own tick of
    a claim counts before that of a source, and that before a question day's. Of two question days the first in the note counts,
    of two own ticks the last.
    """
    day = ticks.filter("kind = 'qday'").select("report", F.col("subject").alias("log"), "verdict", "place").join(logs.select("log", F.concat(F.array("log"), "claims", "sources").alias("_all")), "log")
    held = day.select("report", F.explode("_all").alias("subject"), "verdict", F.lit("question_day").alias("provenance"), (-F.col("place")).alias("place"), F.lit(0).alias("rank"))
    rank = F.when(F.col("kind") == "claim", 2).otherwise(1)
    own = ticks.filter("kind IN ('source', 'claim')").select("report", "subject", "verdict", F.col("kind").alias("provenance"), "place", rank.alias("rank"))
    best = F.max_by(F.struct("verdict", "provenance"), F.struct("rank", "place"))
    return held.unionByName(own).groupBy("report", "subject").agg(best.alias("r")).select("report", "subject", "r.*")


def recommender_seeds(labels: DataFrame, of_claims: DataFrame, sources: DataFrame, today: Column, seed: str, negatives: int = 5) -> DataFrame:
    """One row: positive, negative, lists of paper ids that a line's labels point to, by address; where nothing is labelled wrong,
    negatives are drawn by a hash of the seed from papers fetched before today that aren't positive.

    labels: subject (a source or a claim), verdict. of_claims: claim, source. sources: source, url, fetched (day). The lists
    are as long as the author has labelled, or `negatives`.
    """
    own = labels.join(sources.select(F.col("source").alias("subject")), "subject", "left_semi").select(F.col("subject").alias("source"), "verdict")
    claimed = labels.join(of_claims.select(F.col("claim").alias("subject"), "source"), "subject").select("source", "verdict")
    papers = sources.select("source", "url", "fetched", keys.recommender_id(F.col("url")).alias("paper")).filter("paper IS NOT NULL")
    named = own.unionByName(claimed).join(papers, "source").select("verdict", "url", "paper").distinct()
    listed = lambda v: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct("url", "paper")))), lambda x: x["paper"]))
    sides = named.agg(listed("correct").alias("positive"), listed("incorrect").alias("negative"))
    good = named.filter("verdict = 'correct'").select("paper").distinct()
    pool = papers.filter(F.col("fetched") < today).select("paper").distinct().join(good, "paper", "left_anti")
    order = F.xxhash64(F.lit(seed), F.col("paper"))
    drawn = pool.orderBy(order, "paper").limit(negatives).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "paper"))), lambda x: x["paper"]).alias("drawn"))
    return sides.crossJoin(F.broadcast(drawn)).select("positive", F.when(F.size("negative") > 0, F.col("negative")).otherwise(F.col("drawn")).alias("negative"))  # a row each


def withdrawn(stored: DataFrame, harvested: DataFrame, blank: DataFrame, key: list[str]) -> DataFrame:
    """Stored labels whose box is blank now and that no new label replaces."""
    return stored.join(blank.select(*key), key, "left_semi").join(harvested.select(*key), key, "left_anti")


def first_harvests(labels: DataFrame, stored: DataFrame, key: list[str], now: Column) -> DataFrame:
    """labels with first_harvested_at: that of the stored label, also where that is unknown, else now."""
    known = stored.select(*key, F.struct("first_harvested_at").alias("_known"))
    return labels.join(known, key, "left").withColumn("first_harvested_at", F.when(F.col("_known").isNull(), now).otherwise(F.col("_known.first_harvested_at"))).drop("_known")


def without_shared_keys(items: DataFrame, others: DataFrame, item: str, keys: str) -> DataFrame:
    """Items that share no key (in an array) with any of the others."""
    theirs = others.select(F.explode(keys).alias("_k")).distinct()
    shared = items.select(item, F.explode(keys).alias("_k")).join(theirs, "_k", "left_semi").select(item).distinct()
    return items.join(shared, item, "left_anti")


#: Keys of papers.
PAPERS = ("arxiv:", "doi:", "gh:")


def hits_before(sightings: DataFrame, cites: DataFrame, as_of: Column, days: int = 30, prefixes: tuple[str, ...] = PAPERS) -> DataFrame:
    """One row: hits (keys sighted within days that were cited on an earlier day than the sighting), sightings.

    sightings: key, first_seen, baseline (was there when looking began), unsure (may have been there before). Those count
    for nothing, nor do keys that are no paper's.
    """
    paper = F.lit(False)
    for p in prefixes:
        paper |= F.startswith(F.col("key"), F.lit(p))
    sure = paper & ~F.coalesce("baseline", F.lit(False)) & ~F.coalesce("unsure", F.lit(False))
    recent = sightings.filter(sure & (F.col("first_seen") > F.date_sub(as_of, days)) & (F.col("first_seen") <= as_of))
    firsts = cites.groupBy("key").agg(F.min("day").alias("_cited"))
    return recent.join(firsts, "key", "left").agg(F.count_if(F.col("_cited") < F.col("first_seen")).alias("hits"), F.count("*").alias("sightings"))


def asked_counts(records: DataFrame) -> DataFrame:
    """report and how many questions its latest run record asked (records: report, started_at, questions)."""
    return records.groupBy("report").agg(F.max_by(F.size("questions"), "started_at").alias("asked"))


def question_orders(records: DataFrame) -> DataFrame:
    """line, day, n and the questions in the order of that day's latest record of n questions."""
    return records.withColumn("n", F.size("questions")).groupBy("line", "day", "n").agg(F.max_by("questions", "started_at").alias("questions"))


def passed_questions(judged: DataFrame, orders: DataFrame, cut: float = 0.5) -> DataFrame:
    """line, day, source, question of each probability (an array in the order of the questions) that reaches the cut.

    A judgment of a day without a record of as many questions is left out.
    """
    each = judged.withColumn("n", F.size("p")).join(orders, ["line", "day", "n"])
    hit = F.filter(F.arrays_zip("questions", "p"), lambda x: x["p"] >= cut)
    return each.select("line", "day", "source", F.explode(hit).alias("h")).select("line", "day", "source", F.col("h.questions").alias("question"))


def first_judgments(pairs: DataFrame, judged: DataFrame, key: list[str], time: str, value: str, out: str) -> DataFrame:
    """pairs with the value of the first judgment of their key, null without one."""
    return pairs.join(judged.groupBy(*key).agg(F.min_by(value, time).alias(out)), key, "left")


def screens_within(screens: DataFrame, key: list[str], time: str, days: int = 7) -> DataFrame:
    """The judgments of each pair within days of its first one."""
    first = screens.groupBy(*key).agg(F.min(time).alias("_first"))
    return screens.join(first, key).filter(F.datediff(time, "_first") <= days).drop("_first")


def line_runs(records: DataFrame, reports: DataFrame, key: list[str]) -> DataFrame:
    """key, started_at, report of every run of a line: its latest record with the report of that day, and reports that no record covers."""
    latest = records.groupBy(*key).agg(F.max("started_at").alias("started_at"))
    return latest.join(reports.select(*key, "report"), key, "full")


def gold(labels: DataFrame, key: list[str], positive: Column) -> DataFrame:
    """key and gold: true if any of its labels is positive, however it came by it."""
    return labels.groupBy(*key).agg(F.bool_or(positive).alias("gold"))


def ordinals(claims: DataFrame, question: list[str], *order: Column) -> DataFrame:
    """Adds n, the number by which a claim is cited within its question."""
    return claims.withColumn("n", F.row_number().over(Window.partitionBy(*question).orderBy(*order)))


def known_before(rows: DataFrame, key: list[str], day: str, out: str = "known") -> DataFrame:
    """Adds whether the key was there on an earlier day. A minimum a key, joined: no running sets."""
    firsts = rows.groupBy(*key).agg(F.min(day).alias("_first"))
    return rows.join(firsts, key).withColumn(out, F.col("_first") < F.col(day)).drop("_first")


def rotation(lines: DataFrame, position: str, start: int, k: int, n: int) -> DataFrame:
    """The k lines of n whose turn it is, with turn (from 0) and the start of the next run, resume."""
    turn = F.pmod(F.col(position) - start, F.lit(n))
    return lines.withColumn("turn", turn).filter(F.col("turn") < k).withColumn("resume", F.lit((start + k) % n))


def evidence_growth(questions: DataFrame, accepted: DataFrame, question: str) -> DataFrame:
    """questions with the accepted claims (an ordered list a question) behind their evidence, none twice."""
    return questions.join(accepted, question, "left").withColumn("evidence", F.array_union("evidence", F.coalesce("accepted", F.array().cast("array<string>")))).drop("accepted")


def in_all(cases: DataFrame, case: str, variant: str) -> DataFrame:
    """The cases that every variant has."""
    n = cases.agg(F.count_distinct(variant).alias("_all"))
    return cases.groupBy(case).agg(F.count_distinct(variant).alias("_n")).crossJoin(F.broadcast(n)).filter("_n = _all").select(case)
