"""The measurement registry over stand-ins: events of each type are runs' records, sections, labels, notes and sightings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instruments
from .queries import EVENTS, events
from .registry import query

HOLIDAYS, SINCE, REVIEW_BY, PATTERN = ["2024-01-10"], "2024-01-04", "2024-01-20", "_line_"


def facts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e, c = events(spark, sf_dir), F.col
    kind, k = c("event_type"), c("k")
    of = lambda t: e.filter(kind == t)
    month_day = F.dayofmonth("day")
    runs = e.groupBy("line", "day").agg(F.when(F.dayofmonth("day") % 13 != 0, F.min("ts")).alias("started_at"), *[F.count_if(x).alias(n) for n, x in (("writer_calls", kind == "click"), ("tokens", c("value") > 45), ("questions", kind == "error"), ("claims", (kind == "purchase") & (c("value") > 30)))])
    runs = runs.withColumns({"report": F.when(month_day % 9 != 0, F.concat_ws(":", "line", "day")), "budget": c("line")})
    stage = F.element_at(F.array(*map(F.lit, (instruments.ARXIV, instruments.DAILY, instruments.CITING))), k % 3 + 1)
    stages = of("view").select("line", stage.alias("stage"), c("ts").alias("completed_at"), F.array_repeat(F.lit("o"), k % 4).alias("outputs"))
    claims = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda j: j < k % 5), lambda j: F.concat(F.lit("c"), (c("user_id") + j).cast("string")))
    logs = of("purchase").select("line", "day", c("event_id").alias("log"), c("ts").alias("logged_at"), F.concat(F.lit("a [1] b ["), k.cast("string"), F.lit("]")).alias("text"), claims.alias("claims"))
    sources = of("purchase").filter("user_id % 7 <> 0").select(F.concat(F.lit("c"), c("user_id").cast("string")).alias("claim"), F.concat(F.lit("s"), F.expr("user_id div 3").cast("string")).alias("source"))
    first = F.when(k % 5 == 1, c("ts") + F.expr("INTERVAL 1 DAY")).when(k % 5 != 0, c("ts") - F.make_dt_interval(hours=k))
    labels = of("signup").select(c("event_id").alias("label"), c("ts").alias("harvested_at"), first.alias("first_harvested_at"), F.date_sub("day", k % 3).alias("written"))
    opened = of("error").select(F.concat(F.date_add("day", k % 3 - 1).cast("string"), F.lit("_line_"), c("user_id").cast("string")).alias("note"), "day")
    sightings = of("click").select(F.element_at(F.array(*map(F.lit, ("vault", "vault:x", "graph"))), k % 3 + 1).alias("place"), c("day").alias("first_seen"))
    return [instruments.run_facts(runs), instruments.stage_facts(stages), instruments.log_facts(logs, sources), instruments.label_facts(labels, SINCE), instruments.opened_facts(opened, PATTERN), instruments.sighting_facts(sightings)]


def weekend(day: str) -> str:
    return f"isodow({day}) >= 6"


LISTING_DAY = "CAST(fetched - INTERVAL 5 HOUR AS DATE)"
SQL = EVENTS + f""", r AS (SELECT line, day, CASE WHEN day(day) % 13 <> 0 THEN min(ts) END AS started_at, day(day) % 9 <> 0 AS reported, count(*) FILTER (event_type = 'click') AS writer_calls, count(*) FILTER (value > 45) AS tokens, count(*) FILTER (event_type = 'error') AS questions,
  count(*) FILTER (event_type = 'purchase' AND value > 30) AS claims FROM e GROUP BY line, day),
 st AS (SELECT line, day, k % 3 AS s, sum(k % 4) AS n, min(ts) AS fetched FROM e WHERE event_type = 'view' GROUP BY 1, 2, 3),
 lg AS (SELECT line, day, event_id AS log, ts, [1, k] AS cited, [('c' || (user_id + j)) for j in range(k % 5)] AS claims FROM e WHERE event_type = 'purchase'),
 cs AS (SELECT DISTINCT 'c' || user_id AS claim, 's' || user_id // 3 AS source FROM e WHERE event_type = 'purchase' AND user_id % 7 <> 0),
 cn AS (SELECT line, day, log, n, CASE WHEN n BETWEEN 1 AND len(claims) THEN claims[n] END AS claim FROM (SELECT line, day, log, claims, unnest(list_distinct(cited)) AS n FROM lg)),
 ci AS (SELECT cn.*, source FROM cn LEFT JOIN cs USING (claim)),
 fc AS (SELECT line, day, count(*) AS n FROM (SELECT line, source, min(day) AS day FROM ci WHERE source IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2),
 br AS (SELECT line, day, arg_min(log || ' [' || n || '] resolves to no source', (CAST(log AS VARCHAR), n)) AS conflict FROM ci WHERE source IS NULL GROUP BY 1, 2),
 wr AS (SELECT r.line, r.day, count(*) AS n FROM r JOIN lg ON lg.line = r.line AND lg.day = r.day AND lg.ts = r.started_at GROUP BY 1, 2),
 lf AS (SELECT event_id AS label, ts AS last, CASE WHEN k % 5 = 1 THEN ts + INTERVAL 1 DAY WHEN k % 5 <> 0 THEN ts - to_hours(k) END AS first, day - k % 3 AS written FROM e WHERE event_type = 'signup'),
 lw AS (SELECT *, label || ': ' || CASE WHEN first IS NULL THEN CASE WHEN written >= DATE '{SINCE}' THEN 'no first harvest on a note written since it is kept' END WHEN first > last THEN 'first harvest after the latest harvest' WHEN CAST(first AS DATE) < written THEN 'first harvest before its note was written' END AS why FROM lf),
 lt AS (SELECT day, sum(n) AS n, min(why) AS conflict FROM (SELECT CAST(first AS DATE) AS day, 1 AS n, NULL AS why FROM lw WHERE first IS NOT NULL UNION ALL SELECT CAST(last AS DATE), 0, why FROM lw WHERE why IS NOT NULL) GROUP BY day),
 op AS (SELECT day, count(*) AS n, min(CASE WHEN day < noted THEN noted || '_line_' || user_id || ' seen opened on ' || day || ', before its own date' END) AS conflict FROM (SELECT day, user_id, day + (k % 3 - 1) AS noted FROM e WHERE event_type = 'error') GROUP BY day),
 si AS (SELECT day, count(*) AS n FROM e WHERE event_type = 'click' AND k % 3 < 2 GROUP BY day),
 td AS (SELECT DISTINCT day FROM r),
 o1 AS (SELECT r.line, r.day, r.reported, CASE WHEN r.reported THEN coalesce(fc.n, 0) END AS v, CASE WHEN r.reported THEN r.claims END AS cl, br.conflict FROM r LEFT JOIN fc ON fc.line = r.line AND fc.day = r.day LEFT JOIN br ON br.line = r.line AND br.day = r.day),
 op1 AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS pv, last_value(cl IGNORE NULLS) OVER w AS pc FROM o1 WINDOW w AS (PARTITION BY line ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 c AS (
  SELECT 'firehose.arxiv' AS instrument, CAST(r.line AS VARCHAR) AS line, r.day, st.n AS value, CAST(NULL AS BIGINT) AS related, st.fetched, CAST(NULL AS VARCHAR) AS conflict FROM r LEFT JOIN st ON st.line = r.line AND st.day = r.day AND st.s = 0 WHERE r.line >= 1
  UNION ALL SELECT 'firehose.hf', CAST(r.line AS VARCHAR), r.day, st.n, NULL, st.fetched, NULL FROM r LEFT JOIN st ON st.line = r.line AND st.day = r.day AND st.s = 1 WHERE r.line >= 2
  UNION ALL SELECT 'citation', CAST(line AS VARCHAR), day, n, NULL, fetched, NULL FROM st WHERE s = 2
  UNION ALL SELECT 'used.vault', 'tick', day, coalesce(n, 0), NULL, NULL, NULL FROM td FULL JOIN si USING (day) WHERE day >= DATE '{SINCE}'
  UNION ALL SELECT 'writer_calls', CAST(r.line AS VARCHAR), r.day, CASE WHEN reported THEN writer_calls END, CASE WHEN reported THEN coalesce(wr.n, 0) END, NULL, NULL FROM r LEFT JOIN wr ON wr.line = r.line AND wr.day = r.day WHERE started_at IS NOT NULL AND r.day >= DATE '{SINCE}'
  UNION ALL SELECT 'judge_tokens', CAST(line AS VARCHAR), day, CASE WHEN reported THEN tokens END, CASE WHEN reported THEN questions END, NULL, NULL FROM r WHERE day >= DATE '{SINCE}'
  UNION ALL SELECT 'o1', CAST(line AS VARCHAR), day, v, CASE WHEN reported THEN pv END, NULL, CASE WHEN reported THEN conflict END FROM op1
  UNION ALL SELECT 'claims_posted', CAST(line AS VARCHAR), day, cl, CASE WHEN reported THEN pc END, NULL, NULL FROM op1
  UNION ALL SELECT 'label.first_harvest', 'tick', day, coalesce(n, 0), NULL, NULL, conflict FROM td FULL JOIN lt USING (day) WHERE day >= DATE '{SINCE}'
  UNION ALL SELECT 'opened', 'tick', day, coalesce(n, 0), NULL, NULL, conflict FROM td FULL JOIN op USING (day) WHERE day >= DATE '{SINCE}'),
 x AS (SELECT *, CASE WHEN instrument = 'firehose.arxiv' THEN CASE WHEN fetched IS NOT NULL AND ({weekend(LISTING_DAY)} OR {LISTING_DAY} - 1 = DATE '{HOLIDAYS[0]}') THEN 'zero' ELSE 'positive' END WHEN instrument = 'firehose.hf' THEN CASE WHEN fetched IS NOT NULL AND {weekend("CAST(fetched AS DATE) - 1")} THEN 'zero' ELSE 'positive' END
  WHEN instrument IN ('writer_calls', 'judge_tokens') THEN CASE WHEN related > 0 THEN 'agrees' ELSE 'any' END WHEN instrument IN ('o1', 'claims_posted') THEN CASE WHEN related = 0 THEN 'positive' ELSE 'any' END ELSE 'any' END AS expect, instrument IN ('citation', 'used.vault') AS declared FROM c),
 y AS (SELECT *, CASE WHEN value IS NULL THEN 'missing' WHEN conflict IS NOT NULL OR (value > 0 AND expect = 'zero') THEN 'contradiction' WHEN value > 0 THEN 'live' WHEN expect = 'agrees' THEN 'contradiction' WHEN declared THEN CASE WHEN day > DATE '{REVIEW_BY}' THEN 'unexplained-zero' ELSE 'declared-degenerate' END WHEN expect = 'positive' THEN 'unexplained-zero' ELSE 'expected-zero' END AS s FROM x),
 z AS (SELECT *, CASE WHEN s = 'live' THEN sum(CASE WHEN s = 'live' AND (before IS NULL OR before <> value) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, line ORDER BY day) END AS island FROM (SELECT *, lag(value) OVER (PARTITION BY instrument, line, s = 'live' ORDER BY day) AS before FROM y))
"""


@query(SQL + """SELECT instrument, line, day, CAST(value AS BIGINT) AS value, CAST(related AS BIGINT) AS related, conflict, expect, CASE WHEN s = 'live' AND instrument IN ('firehose.arxiv', 'judge_tokens') AND row_number() OVER (PARTITION BY instrument, line, island ORDER BY day) >= 3 THEN 'stuck' ELSE s END AS status FROM z""")
def instrument_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instruments.grouped(facts(spark, sf_dir))
    return instruments.readings(rows, instruments.registry(HOLIDAYS, SINCE, REVIEW_BY)).drop("part", "at")
