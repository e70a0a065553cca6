"""More queries: shares, yields, arms, slots and repeated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import measures, windows
from ..sources import graph
from .queries import EVENTS, PAIRS, QUERY, URL, events, pairs, stripped_sql
from .registry import query, table


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.shares(table(spark, sf_dir, "documents"), "source").withColumn("share", F.round("share", 6))


@query(EVENTS + """, d AS (SELECT DISTINCT user_id, k, event_type FROM e), n AS (SELECT user_id, k, count(*) AS c FROM d GROUP BY user_id, k)
SELECT event_type, count(*) AS "found", count(*) FILTER (c = 1) AS "unique" FROM d JOIN n USING (user_id, k) GROUP BY event_type""")
def found_and_unique_by_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.found_and_unique(events(spark, sf_dir), ["user_id", "k"], "event_type")


@query(EVENTS + """, a AS (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, k FROM e WHERE event_type = 'purchase')
SELECT user_id, k, 'a' AS arm FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT user_id, k, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def found_by_one_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return measures.only_one_arm(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["user_id", "k"])


@query(EVENTS + """, s AS (SELECT user_id, day, count(*) FILTER (value > 40) AS fresh FROM e GROUP BY user_id, day), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS r FROM s)
SELECT user_id, array_to_string(list(fresh ORDER BY r DESC), ',') AS yields, count(*) >= 3 AND max(fresh) FILTER (r <= 3) = 0 AS exhausted FROM r WHERE r <= 5 GROUP BY user_id""")
def trailing_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends = events(spark, sf_dir).groupBy("user_id", "day").agg(F.count_if(F.col("value") > 40).alias("fresh"))
    found = measures.trailing_yields(sends, "user_id", "day", "fresh")
    return found.withColumn("yields", F.array_join(F.transform("yields", lambda n: n.cast("string")), ","))


@query(EVENTS + """, c AS (SELECT line, day, event_type, count(*) AS n FROM e WHERE value > 45 GROUP BY 1, 2, 3), q AS (SELECT line, day, count(*) AS k FROM c GROUP BY 1, 2), x AS (SELECT c.line, c.day, n, least(5, greatest(2, 9 // k)) AS cap FROM c JOIN q ON c.line = q.line AND c.day = q.day)
SELECT line, day, CAST(sum(greatest(cap - n, 0)) AS BIGINT) AS free, CAST(sum(cap) AS BIGINT) AS slots FROM x GROUP BY line, day""")
def free_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = events(spark, sf_dir).filter("value > 45")
    return measures.slots(claims, ["line", "day"], "event_type", windows.claims_per_question(F.col("questions")))


@query("SELECT lang, list(n_chars ORDER BY n_chars)[count(*) // 2 + 1] AS chars FROM documents GROUP BY lang")
def upper_median_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(measures.upper_median("n_chars").alias("chars"))


@query(PAIRS + """, l AS (SELECT doc_id % 300 AS q, arg_max(trust, doc_id) AS b, arg_max(method, doc_id) AS a FROM p GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER ((b >= 0.5) <> (a >= 0.5)) AS flips, round(avg(abs(a - b)), 6) AS mean_change, round(max(abs(a - b)), 6) AS most_change FROM l""")
def answer_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("q", F.col("doc_id") % 300)
    found = measures.jitter(p, ["q"], "doc_id", "trust", "method", 0.5)
    return found.select("n", "flips", F.round("mean_change", 6).alias("mean_change"), F.round("most_change", 6).alias("most_change"))


@query(PAIRS + """SELECT round(sum(CASE WHEN (trust >= 0.4) = gold THEN w ELSE 0 END) / sum(w), 6) AS accuracy FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM p WHERE gold IS NOT NULL)""")
def accuracy_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = pairs(spark, sf_dir).filter("gold IS NOT NULL")
    found = measures.weighted_accuracy(labelled, "trust", "gold", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.5), 0.4)
    return found.select(F.round("accuracy", 6).alias("accuracy"))


@query(EVENTS + """SELECT k, CASE WHEN count(*) FILTER (event_type = 'view' AND value > 40) = 0 THEN 'view' WHEN count(*) FILTER (event_type = 'click' AND value > 40) = 0 THEN 'click' WHEN count(*) FILTER (event_type = 'purchase' AND value > 40) = 0 THEN 'purchase' END AS stuck_at FROM e WHERE value > 40 GROUP BY k""")
def stuck_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.stuck_stage(events(spark, sf_dir).filter("value > 40"), "k", "event_type", ["view", "click", "purchase"])


@query("""SELECT o_custkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, round(sum(o_totalprice), 2) AS spent, count(*) AS calls FROM orders GROUP BY 1, 2""")
def weekly_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("week", F.to_date(F.date_trunc("WEEK", "o_orderdate")))
    return rows.groupBy("o_custkey", "week").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("calls"))


@query("""WITH s AS (SELECT conv_id AS id, list(CAST(turn AS VARCHAR) ORDER BY turn) AS outputs FROM conversations GROUP BY conv_id)
SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(s.outputs) AS o) u WHERE u.o NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey < 6))""")
def cached_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.col("turn").cast("string")).alias("outputs"))
    nodes = table(spark, sf_dir, "nation").filter("n_nationkey < 6").select(F.col("n_nationkey").cast("string").alias("id"))
    return graph.stage_hits(stages, nodes).select("id")


@query("""SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01'""")
def reported_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < F.lit("1995-03-01").cast("timestamp_ntz")).select("o_custkey", "o_orderpriority").distinct()


#: Addresses of the shared pages name no registered work, so a page's key is its normalized address.
SLUG = r"trim(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-')"


@query(QUERY + rf""", k AS (SELECT page_id, 'url:' || {URL} AS key, {stripped_sql("html")} AS line, nullif({stripped_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title FROM q),
 h AS (SELECT *, substr(line, 1, 120) AS head, {SLUG} AS words FROM k), b AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS back FROM h)
SELECT page_id, key, CASE WHEN length(line) <= 120 THEN line ELSE regexp_replace(CASE WHEN contains(head, ' ') AND back > 60 THEN substr(head, 1, CAST(back AS INTEGER)) ELSE head END, '[ ,;:—-]+$', '') || '…' END AS gist,
 CASE WHEN words = '' THEN 'q-' || substr(sha256(title), 1, 8) ELSE trim(substr(words, 1, 40), '-') END AS slug FROM b""")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", keys.paper_key(F.col("url")).alias("key"), keys.gist(keys.strip_tags(F.col("html"))).alias("gist"), keys.slug(keys.page_title(F.col("html"))).alias("slug"))


@query()
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    days = events(spark, sf_dir).groupBy("day").agg((F.count_if(kind == "click") - F.count_if(kind == "view")).alias("d"))
    return measures.bootstrap(days, "day", "d")


@query(EVENTS + """, w AS (SELECT DISTINCT printf('%04d-W%02d', isoyear(day), weekofyear(day)) AS week, day FROM e)
SELECT week, day, CAST(date_trunc('week', day) AS DATE) AS start, printf('%04d-W%02d', isoyear(date_trunc('week', day) - INTERVAL 21 DAY), weekofyear(date_trunc('week', day) - INTERVAL 21 DAY)) AS before,
 printf('%04d-W%02d', isoyear(date_trunc('week', day) - INTERVAL 7 DAY), weekofyear(date_trunc('week', day) - INTERVAL 7 DAY)) AS complete, true AS holds FROM w""")
def weeks_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(keys.iso_week(F.col("day")).alias("week"), "day").distinct()
    return rows.select("week", "day", keys.week_start(F.col("week")).alias("start"), keys.shifted_week(F.col("week"), -3).alias("before"), keys.last_complete_week(F.col("day")).alias("complete"), keys.in_week(F.col("week"), F.col("day")).alias("holds"))


@query(EVENTS + """, d AS (SELECT line, day, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'purchase') AS b FROM e GROUP BY 1, 2), m AS (SELECT sum(b - a) AS total, count(*) AS days, stddev_samp(b - a) AS sd, sum(a) AS a, sum(b) AS b FROM d)
SELECT CAST(a AS BIGINT) AS now, CAST(b AS BIGINT) AS "then", CAST(total AS DOUBLE) AS total, days FROM m""")
def pooled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines' days as the units of one difference; its interval and p by draws are tested against paired_difference()."""
    kind = F.col("event_type")
    days = events(spark, sf_dir).groupBy("line", "day").agg(F.count_if(kind == "click").alias("a"), F.count_if(kind == "purchase").alias("b"))
    return measures.pooled_difference(days, ["line", "day"], "a", "b").select("now", "then", "total", "days")


@query("""WITH c AS (SELECT doc_id % 700 AS item, CASE WHEN doc_id % 2 = 0 THEN 's' ELSE 'x' END AS kind, doc_id AS asked, CASE WHEN n_chars % 5 > 0 THEN ['yes', 'partial', 'no'][n_chars % 3 + 1] END AS answer, 'r' || doc_id % 3 AS rubric FROM documents),
 t AS (SELECT item, arg_max(answer, asked) AS answer FROM c WHERE answer IS NOT NULL AND rubric = CASE kind WHEN 's' THEN 'r0' ELSE 'r1' END GROUP BY 1) SELECT item, answer, answer IN ('yes', 'partial') AS positive FROM t""")
def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    answer = F.when(c("n_chars") % 5 > 0, F.element_at(F.array(*map(F.lit, ("yes", "partial", "no"))), (c("n_chars") % 3 + 1).cast("int")))
    calls = table(spark, sf_dir, "documents").select((c("doc_id") % 700).alias("item"), F.when(c("doc_id") % 2 == 0, "s").otherwise("x").alias("kind"), c("doc_id").alias("at"), answer.alias("answer"), F.concat(F.lit("r"), (c("doc_id") % 3).cast("string")).alias("rubric"))
    return measures.item_labels(calls, spark.createDataFrame([("s", "r0"), ("x", "r1")], "kind string, rubric string"))
