"""The weekly review over stand-ins: clicks are shown, views are posted, and events are labels of papers k of their line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from ..operators.cohorts import week_of
from .queries import EVENTS, HEALTH, cells_of, events
from .registry import query

WEEK = "CAST(date_trunc('week', day) AS DATE)"
REPEATS = f"""rs AS (SELECT user_id, k, min(day) AS d FROM e WHERE event_type = 'click' GROUP BY 1, 2), rp AS (SELECT user_id, k, min(day) AS d FROM e WHERE event_type = 'view' GROUP BY 1, 2),
 rr AS (SELECT {WEEK} AS week, count(*) AS entries, count(*) FILTER (least(rs.d, coalesce(rp.d, rs.d)) < e.day) AS repeats FROM e JOIN rs USING (user_id, k) LEFT JOIN rp USING (user_id, k) WHERE event_type = 'click' GROUP BY 1)"""
AUTHOR = f"""wk AS (SELECT DISTINCT {WEEK} AS week FROM e), al AS (SELECT line, day, CASE WHEN user_id % 3 <> 0 THEN k * 1000 + user_id % 90 END AS paper, value > 25 AS correct, event_type = 'view' AS qday, user_id % 2 = 0 AS log, CASE WHEN k <> 5 OR user_id % 7 > 0 THEN day END AS first FROM e),
 ap AS (SELECT line, paper, min(first) AS first, bool_or(first IS NULL) AS unsure FROM al WHERE correct AND paper IS NOT NULL GROUP BY 1, 2),
 ac AS (SELECT week, count(*) AS positives, count(*) FILTER (NOT unsure AND first > week + 6 - 14) AS added, count(*) FILTER (unsure) AS unknown FROM wk JOIN ap ON unsure OR first <= week + 6 GROUP BY week),
 ab AS (SELECT CAST(date_trunc('week', first) AS DATE) AS week, count(*) AS ticks FROM al WHERE qday AND log AND first IS NOT NULL GROUP BY 1),
 au AS (SELECT week, coalesce(ticks, 0) AS ticks, CAST(coalesce(positives, 0) AS BIGINT) AS positives, coalesce(added, 0) AS added, coalesce(unknown, 0) AS unknown FROM wk LEFT JOIN ac USING (week) LEFT JOIN ab USING (week))"""
EXCEPTIONS = f"""xz AS (SELECT week, count(*) FILTER (n = 0) AS zero_lines FROM (SELECT {WEEK} AS week, line, count(*) FILTER (event_type = 'signup' AND value > 48) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
 xf AS (SELECT {WEEK} AS week, count(DISTINCT event_type) FILTER (status IN ('missing', 'contradiction', 'unexplained-zero', 'stuck')) AS failing FROM s GROUP BY 1),
 xs AS (SELECT week, count(*) FILTER (NOT moved) AS stuck FROM (SELECT {WEEK} AS week, line, event_type, bool_or(value > 49.5) AS moved FROM e GROUP BY 1, 2, 3) GROUP BY 1),
 xx AS (SELECT week, zero_lines, failing, stuck, zero_lines + failing + stuck AS exceptions FROM xz JOIN xf USING (week) JOIN xs USING (week))"""


def repeats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return review.review_repeats(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id", "k"], "day")


def author_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = events(spark, sf_dir), F.col
    first = F.when((c("k") != 5) | (c("user_id") % 7 > 0), c("day"))
    labels = e.select("line", F.when(c("user_id") % 3 != 0, c("k") * 1000 + c("user_id") % 90).alias("paper"), F.when(c("value") > 25, "correct").otherwise("wrong").alias("verdict"), F.when(c("event_type") == "view", "question_day").otherwise("source").alias("provenance"), (c("user_id") % 2 == 0).alias("log"), first.alias("first"))
    return review.author_signal(labels, e.select(week_of("day").alias("week")))


def exceptions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = events(spark, sf_dir), F.col
    weekly = e.withColumn("week", week_of("day"))
    lines = weekly.groupBy("week", "line").agg(F.count_if((c("event_type") == "signup") & (c("value") > 48)).alias("count"))
    cells = cells_of(spark, sf_dir).select(week_of("day").alias("week"), F.col("event_type").alias("instrument"), "status")
    questions = weekly.groupBy("week", "line", F.col("event_type").alias("question")).agg(F.bool_or(c("value") > 49.5).alias("moved"))
    return review.exceptions(lines, cells, questions)


@query(EVENTS + ", " + REPEATS + " SELECT * FROM rr")
def review_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_of(spark, sf_dir)


@query(EVENTS + ", " + AUTHOR + " SELECT * FROM au")
def author_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_of(spark, sf_dir)


@query(HEALTH + ", " + EXCEPTIONS + " SELECT * FROM xx")
def weekly_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exceptions_of(spark, sf_dir)


@query(HEALTH + f", {REPEATS}, {AUTHOR}, {EXCEPTIONS}" + """ SELECT week, '{"author":{"added":' || added || ',"positives":' || positives || ',"ticks":' || ticks || ',"unknown":' || unknown || '},"exceptions":{"exceptions":' || exceptions || ',"failing":' || failing || ',"stuck":' || stuck || ',"zero_lines":' || zero_lines ||
 '},"repeats":' || CASE WHEN entries IS NULL THEN 'null' ELSE '{"entries":' || entries || ',"repeats":' || repeats || '}' END || ',"week":"' || week || '"}' AS row FROM au JOIN xx USING (week) LEFT JOIN rr USING (week)""")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_rows({"author": author_of(spark, sf_dir), "exceptions": exceptions_of(spark, sf_dir), "repeats": repeats_of(spark, sf_dir)})
