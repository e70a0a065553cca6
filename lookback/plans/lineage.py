"""Queries over citations, labels and runs: from what was said back to what it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage
from .queries import EVENTS, events, hashed, hashed_sql
from .registry import query, table

CHAIN = """WITH c AS (SELECT l.l_orderkey * 10 + l.l_linenumber AS claim, l.l_orderkey AS unit, o.o_custkey AS source FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 JOIN customer s ON o.o_custkey = s.c_custkey WHERE s.c_acctbal > 0)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as claims, orders as their units, customers with money as sources."""
    claims = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), F.col("l_orderkey").alias("unit"))
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("source"))
    sources = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("source"))
    return lineage.claim_sources(claims, units, sources)


@query(CHAIN + " SELECT claim, unit, source FROM c")
def claim_source_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(spark, sf_dir)


LOGS = EVENTS + """, g AS (SELECT user_id AS question, day, list(event_id ORDER BY event_id) AS claims, list(k) AS ks FROM e GROUP BY 1, 2),
 o AS (SELECT event_id AS claim, user_id AS source FROM e WHERE event_type <> 'error')"""


def logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A user's day as a log of its events, whose text cites [k] of each; events but errors have a source."""
    e = events(spark, sf_dir)
    text = F.array_join(F.transform(F.collect_list("k"), lambda k: F.concat(F.lit("["), k.cast("string"), F.lit("]"))), " and ")
    found = e.groupBy(F.col("user_id").alias("question"), "day").agg(F.array_sort(F.collect_list("event_id")).alias("claims"), text.alias("text"))
    return found, e.filter("event_type <> 'error'").select(F.col("event_id").alias("claim"), F.lit(0).alias("unit"), F.col("user_id").alias("source"))


@query(LOGS + """, n AS (SELECT question, day, claims, unnest(list_distinct(ks)) AS n FROM g), r AS (SELECT question, day, n, claims[n] AS claim FROM n WHERE n BETWEEN 1 AND len(claims))
SELECT question, day, CAST(n AS BIGINT) AS n, claim, source FROM r LEFT JOIN o USING (claim)""")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.cited_sources(*logs(spark, sf_dir))


@query(LOGS + """, n AS (SELECT question, day, claims, unnest(list_distinct(ks)) AS n FROM g), r AS (SELECT question, day, n, claims[n] AS claim FROM n WHERE n BETWEEN 1 AND len(claims)),
 u AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY question, n) AS i FROM r ANTI JOIN o USING (claim)) SELECT day, question, CAST(n AS BIGINT) AS n, claim FROM u WHERE i = 1""")
def first_unresolved_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.first_unresolved(lineage.cited_sources(*logs(spark, sf_dir)))


@query(LOGS + """, p AS (SELECT question, day, unnest(range(1, len(claims) + 1)) AS place, unnest(claims) AS claim FROM g) SELECT question, day, CAST(place AS INTEGER) AS place, claim, source FROM p JOIN o USING (claim)""")
def posted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.posts(*logs(spark, sf_dir))


@query(LOGS + " SELECT day, CAST(sum(len(list_distinct(ks))) AS BIGINT) AS cited FROM g GROUP BY day")
def cited_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.cited_counts(logs(spark, sf_dir)[0], "day")


@query(CHAIN + """, j AS (SELECT 'source' AS kind, c_custkey AS subject FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'unit', o_orderkey FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'claim', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT kind || ':' || subject AS judgment, CASE WHEN kind = 'claim' THEN subject ELSE claim END AS claim FROM j LEFT JOIN c ON (kind = 'source' AND source = subject) OR (kind = 'unit' AND unit = subject) WHERE kind = 'claim' OR claim IS NOT NULL""".replace(
    "LEFT JOIN c ON (kind = 'source' AND source = subject) OR (kind = 'unit' AND unit = subject) WHERE kind = 'claim' OR claim IS NOT NULL", "JOIN (SELECT claim, 'source' AS kind, source AS subject FROM c UNION ALL SELECT claim, 'unit', unit FROM c UNION ALL SELECT DISTINCT l_orderkey * 10 + l_linenumber, 'claim', l_orderkey * 10 + l_linenumber FROM lineitem) USING (kind, subject)"))
def judged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = [
        table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.lit("source").alias("kind"), F.col("c_custkey").alias("subject")),
        table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.lit("unit").alias("kind"), F.col("o_orderkey").alias("subject")),
        table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.lit("claim").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("subject")),
    ]
    judgments = subjects[0].unionByName(subjects[1]).unionByName(subjects[2]).withColumn("judgment", F.concat_ws(":", "kind", F.col("subject").cast("string")))
    return lineage.judged_claims(judgments, chain(spark, sf_dir))


@query("""WITH g AS (SELECT 'o' || l_orderkey AS log, list_distinct(list('p' || l_partkey)) || list_distinct(list('s' || l_suppkey)) || ['o' || l_orderkey] AS held FROM lineitem GROUP BY 1),
 t AS (SELECT o_custkey % 50 AS report, 'qday' AS kind, 'o' || o_orderkey AS subject, o_orderstatus AS verdict, o_orderkey AS place FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT p_partkey % 50, 'claim', 'p' || p_partkey, p_brand, p_partkey FROM part WHERE p_size > 40 UNION ALL SELECT s_suppkey % 50, 'source', 's' || s_suppkey, s_name, s_suppkey FROM supplier),
 a AS (SELECT report, unnest(held) AS subject, verdict, 'question_day' AS provenance, 0 AS rank, -place AS place FROM t JOIN g ON log = subject WHERE kind = 'qday' UNION ALL SELECT report, subject, verdict, kind, CASE kind WHEN 'claim' THEN 2 ELSE 1 END, place FROM t WHERE kind <> 'qday'),
 r AS (SELECT *, row_number() OVER (PARTITION BY report, subject ORDER BY rank DESC, place DESC) AS i FROM a) SELECT report, subject, verdict, provenance FROM r WHERE i = 1""")
def propagated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    logs = table(spark, sf_dir, "lineitem").groupBy(name("o", "l_orderkey").alias("log")).agg(F.collect_set(name("p", "l_partkey")).alias("claims"), F.collect_set(name("s", "l_suppkey")).alias("sources"))

    def tick(rows: DataFrame, kind: str, report: str, subject: Column, verdict: str, place: str) -> DataFrame:
        return rows.select((F.col(report) % 50).alias("report"), F.lit(kind).alias("kind"), subject.alias("subject"), F.col(verdict).alias("verdict"), F.col(place).alias("place"))

    urgent = tick(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), "qday", "o_custkey", name("o", "o_orderkey"), "o_orderstatus", "o_orderkey")
    claims = tick(table(spark, sf_dir, "part").filter("p_size > 40"), "claim", "p_partkey", name("p", "p_partkey"), "p_brand", "p_partkey")
    sources = tick(table(spark, sf_dir, "supplier"), "source", "s_suppkey", name("s", "s_suppkey"), "s_name", "s_suppkey")
    return lineage.propagated_labels(urgent.unionByName(claims).unionByName(sources), logs)


@query("""WITH s AS (SELECT doc_id, CASE WHEN quality = 1 THEN DATE '2024-01-05' END AS f FROM labels WHERE toxic = 0)
SELECT l.doc_id, CASE WHEN s.doc_id IS NULL THEN DATE '2024-02-01' ELSE s.f END AS first_harvested_at FROM labels l LEFT JOIN s ON l.doc_id = s.doc_id""")
def first_harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    stored = rows.filter("toxic = 0").select("doc_id", F.when(F.col("quality") == 1, F.lit("2024-01-05").cast("date")).alias("first_harvested_at"))
    return lineage.first_harvests(rows.select("doc_id"), stored, ["doc_id"], F.lit("2024-02-01").cast("date"))


@query("""SELECT s.doc_id, s.quality FROM labels s WHERE s.doc_id IN (SELECT doc_id FROM documents WHERE n_chars < 2500) AND s.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def withdrawn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lineage.withdrawn(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs.filter("lang = 'en'"), docs.filter("n_chars < 2500"), ["doc_id"])


@query("""WITH i AS (SELECT o_custkey AS item, list_distinct(list(o_orderpriority || o_orderstatus)) AS keys FROM orders GROUP BY 1), o AS (SELECT DISTINCT o_orderpriority || o_orderstatus AS key FROM orders WHERE o_totalprice > 400000)
SELECT item FROM i WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(i.keys) AS key) x JOIN o USING (key))""")
def without_canary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = table(spark, sf_dir, "orders"), F.concat("o_orderpriority", "o_orderstatus")
    items = orders.groupBy(F.col("o_custkey").alias("item")).agg(F.collect_set(key).alias("keys"))
    return lineage.without_shared_keys(items, orders.filter("o_totalprice > 400000").select(F.array(key).alias("keys")), "item", "keys").select("item")


PAPER_KEY = "['arxiv:', 'doi:', 'gh:', 'url:'][user_id % 4 + 1] || user_id"


@query(EVENTS + f""", s AS (SELECT {PAPER_KEY} AS key, min(day) AS first_seen, bool_or(value < 2) AS baseline, CASE WHEN bool_or(k = 7) THEN true END AS unsure FROM e WHERE event_type = 'signup' GROUP BY 1), c AS (SELECT {PAPER_KEY} AS key, min(day) AS cited FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT count(*) FILTER (cited < first_seen) AS hits, count(*) AS sightings FROM s LEFT JOIN c USING (key) WHERE first_seen > DATE '2024-01-28' - 25 AND first_seen <= DATE '2024-01-28' AND key NOT LIKE 'url:%' AND NOT baseline AND unsure IS NULL""")
def hits_before_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, ("arxiv:", "doi:", "gh:", "url:"))), (F.col("user_id") % 4 + 1).cast("int"))
    e = events(spark, sf_dir).withColumn("key", F.concat(prefix, F.col("user_id").cast("string")))
    unsure = F.when(F.bool_or(F.col("k") == 7), True)
    seen = e.filter("event_type = 'signup'").groupBy("key").agg(F.min("day").alias("first_seen"), F.bool_or(F.col("value") < 2).alias("baseline"), unsure.alias("unsure"))
    return lineage.hits_before(seen, e.filter("event_type = 'purchase'").select("key", "day"), F.lit("2024-01-28").cast("date"), 25)


RECORDS = EVENTS + ", q AS (SELECT line, day, ts AS started_at, user_id AS report, ['q' || x for x in range(k, k + 1 + k % 3)] AS questions FROM e WHERE event_type = 'signup')"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.transform(F.sequence(F.col("k"), F.col("k") + F.col("k") % 3), lambda x: F.concat(F.lit("q"), x.cast("string")))
    return events(spark, sf_dir).filter("event_type = 'signup'").select("line", "day", F.col("ts").alias("started_at"), F.col("user_id").alias("report"), asked.alias("questions"))


@query(RECORDS + " SELECT report, len(arg_max(questions, started_at)) AS asked FROM q GROUP BY report")
def asked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.asked_counts(records(spark, sf_dir))


@query(RECORDS + f""", o AS (SELECT line, day, len(questions) AS n, arg_max(questions, started_at) AS questions FROM q GROUP BY 1, 2, 3),
 j AS (SELECT line, day, event_id AS source, 1 + k % 3 AS n, [{hashed_sql("event_id", "a")}, {hashed_sql("event_id", "b")}, {hashed_sql("event_id", "c")}] AS p FROM e WHERE event_type = 'view'),
 x AS (SELECT line, day, source, unnest(range(1, n + 1)) AS i, p, questions FROM j JOIN o USING (line, day, n)) SELECT line, day, source, questions[i] AS question FROM x WHERE p[i] >= 0.5""")
def passed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.slice(F.array(*[hashed(F.col("event_id"), n) for n in "abc"]), F.lit(1), F.lit(1) + F.col("k") % 3)
    judged = events(spark, sf_dir).filter("event_type = 'view'").select("line", "day", F.col("event_id").alias("source"), p.alias("p"))
    return lineage.passed_questions(judged, lineage.question_orders(records(spark, sf_dir)))


@query(EVENTS + """, p AS (SELECT DISTINCT user_id, k FROM e), c AS (SELECT user_id, k, arg_min(value, ts) AS triage FROM e WHERE event_type = 'click' GROUP BY 1, 2) SELECT user_id, k, triage FROM p LEFT JOIN c USING (user_id, k)""")
def first_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return lineage.first_judgments(e.select("user_id", "k").distinct(), e.filter("event_type = 'click'"), ["user_id", "k"], "ts", "value", "triage")


@query(EVENTS + """, v AS (SELECT * FROM e WHERE event_type = 'view'), f AS (SELECT user_id, min(day) AS f FROM v GROUP BY 1) SELECT event_id, v.user_id, day FROM v JOIN f ON v.user_id = f.user_id WHERE day - f <= 7""")
def screens_within_a_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.screens_within(events(spark, sf_dir).filter("event_type = 'view'").select("event_id", "user_id", "day"), ["user_id"], "day")


@query(EVENTS + """, r AS (SELECT line, day, max(ts) AS started_at FROM e WHERE event_type = 'signup' AND value > 5 GROUP BY 1, 2), p AS (SELECT line, day, max(event_id) AS report FROM e WHERE event_type = 'purchase' AND value > 5 GROUP BY 1, 2)
SELECT line, day, started_at, report FROM r FULL JOIN p USING (line, day)""")
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("value > 5")
    reports = e.filter("event_type = 'purchase'").groupBy("line", "day").agg(F.max("event_id").alias("report"))
    return lineage.line_runs(e.filter("event_type = 'signup'").withColumnRenamed("ts", "started_at"), reports, ["line", "day"])


@query("SELECT source, lang, bool_or(quality = 1) AS gold FROM labels JOIN documents USING (doc_id) GROUP BY source, lang")
def gold_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return lineage.gold(rows, ["source", "lang"], F.col("quality") == 1)


@query(EVENTS + """, f AS (SELECT user_id, k, min(day) AS f FROM e GROUP BY 1, 2) SELECT event_id, CAST(row_number() OVER (PARTITION BY e.user_id, day ORDER BY ts, event_id) AS INTEGER) AS n, f < day AS known FROM e JOIN f ON e.user_id = f.user_id AND e.k = f.k""")
def ordinals_and_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage.known_before(events(spark, sf_dir), ["user_id", "k"], "day")
    return lineage.ordinals(rows, ["user_id", "day"], F.asc("ts"), F.asc("event_id")).select("event_id", "n", "known")


@query("SELECT n_nationkey, CAST((n_nationkey - 22 + 25) % 25 AS INTEGER) AS turn, 2 AS resume FROM nation WHERE (n_nationkey - 22 + 25) % 25 < 5")
def rotation_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.rotation(table(spark, sf_dir, "nation"), "n_nationkey", 22, 5, 25).select("n_nationkey", F.col("turn").cast("int").alias("turn"), "resume")


@query("""WITH q AS (SELECT conv_id, ['x', CAST(min(turn) AS VARCHAR)] AS ev, list(CAST(turn AS VARCHAR) ORDER BY turn) AS acc FROM conversations GROUP BY 1)
SELECT conv_id, 'x,' || array_to_string(list_concat([ev[2]], [a for a in acc if a <> ev[2]]), ',') AS evidence FROM q""")
def evidence_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t"), F.transform(F.array_sort(F.collect_set("turn")), lambda t: t.cast("string")).alias("accepted"))
    questions = rows.select("conv_id", F.array(F.lit("x"), F.col("t").cast("string")).alias("evidence"))
    grown = lineage.evidence_growth(questions, rows.select("conv_id", "accepted"), "conv_id")
    return grown.select("conv_id", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def cases_of_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.in_all(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")
