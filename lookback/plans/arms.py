"""Queries that compare arms: days replayed with a backlog, ratios with posterior intervals, sets of finds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notes
from ..operators import admission, days, posterior, replay, routing, unions
from ..operators.evaluation import Arm
from ..sources import documents
from .queries import EVENTS, PAIRS, events, hashed, outcome_sql, pairs
from .registry import query, table


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what requests brought: views are listings of two services, other types nets of their own."""
    c = F.col
    e = events(spark, sf_dir)
    view, adapter = c("event_type") == "view", F.when(c("k") % 4 == 0, "hf_papers").otherwise("arxiv")
    score = F.when(c("line") != 2, F.round(hashed(c("event_id"), "score"), 6))
    judged = F.when(c("event_id") % 3 == 0, F.date_sub("day", 2))
    return e.select("line", "day", F.when(view, "firehose").otherwise(c("event_type")).alias("net"), F.when(view, adapter).otherwise("web").alias("adapter"), F.when(~view, c("k").cast("string")).alias("query"),
                    F.concat_ws(":", F.when(view, adapter).otherwise(c("event_type")), c("k").cast("string")).alias("via"), c("k").alias("place"), c("event_id").alias("pos"), c("user_id").alias("source"), score.alias("score"), (c("value") * 20).cast("int").alias("chars"), judged.alias("judged_on"))


ARMS = {"today": (Arm(cap=4, off=("error",)), 0), "backlog": (Arm(cap=4, off=("error",), dropped=("7", "8")), 7)}


@query()
def day_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (arm, line, day, source, via) that two arms reach; how a plain loop does it is in the tests."""
    rows = fetched(spark, sf_dir)
    when, start = rows.select("day").distinct(), dt.date(2024, 1, 5)
    found = [days.replay(rows, when, arm, back, start).withColumn("arm", F.lit(name)) for name, (arm, back) in ARMS.items()]
    return found[0].unionByName(found[1])


@query(PAIRS + f""", o AS (SELECT *, CAST({outcome_sql()} = 'keep' AS INT) AS a, CAST({outcome_sql(0.4, 0.55)} = 'keep' AS INT) AS b FROM p),
 c AS (SELECT level, source, a, b, count(*) AS size, count(gold) AS n, coalesce(sum(CAST(gold AS INT)), 0) AS r FROM o GROUP BY 1, 2, 3, 4),
 s AS (SELECT *, sum(n) OVER (PARTITION BY level, source) AS sn, sum(r) OVER (PARTITION BY level, source) AS sr, sum(size * a) OVER (PARTITION BY level) AS ka, sum(size * b) OVER (PARTITION BY level) AS kb FROM c),
 y AS (SELECT *, r + (size - n) * CASE WHEN n > 0 THEN r / n WHEN sn > 0 THEN sr / sn ELSE 0 END AS y FROM s),
 f AS (SELECT level, t.name, CASE t.name WHEN 'recall_now' THEN a WHEN 'recall_then' THEN b WHEN 'recall_change' THEN b - a WHEN 'precision_now' THEN a WHEN 'precision_then' THEN b ELSE b / kb - a / ka END AS top,
   CASE WHEN t.name LIKE 'recall%' THEN 1 ELSE 0 END AS bottom, CASE t.name WHEN 'precision_now' THEN ka WHEN 'precision_then' THEN kb ELSE 1 END AS fixed, y, sn, size FROM y, (VALUES ('recall_now'), ('recall_then'), ('recall_change'), ('precision_now'), ('precision_then'), ('precision_change')) t(name))
SELECT level, name, CASE WHEN NOT bool_or((top <> 0 OR bottom <> 0) AND sn = 0) THEN round(sum(top * y) / CASE WHEN max(bottom) = 1 THEN sum(y) ELSE max(fixed) END, 6) END AS value, CASE WHEN NOT bool_or((top <> 0 OR bottom <> 0) AND sn = 0) THEN true ELSE false END AS measured FROM f GROUP BY 1, 2""")
def posterior_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of each ratio, and whether it has an interval (the intervals themselves are tested against draws)."""
    p = routing.staged_outcome(pairs(spark, sf_dir), routing.Policy(), "now")
    p = routing.staged_outcome(p, routing.Policy().with_(on_topic=0.4, keep=0.55), "then")
    parts = [replay.cells(p.filter(F.col("level") == level), "source", F.col("now") == "keep", F.col("then") == "keep", F.col("gold")).withColumn("level", F.lit(level)) for level in ("personal", "report")]
    found = posterior.estimates(parts[0].unionByName(parts[1]), "level")
    return found.select("level", "name", F.round("value", 6).alias("value"), F.coalesce(F.col("low") <= F.col("high"), F.lit(False)).alias("measured"))


@query(EVENTS + """, f AS (SELECT DISTINCT event_type AS net, k, user_id FROM e WHERE user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'signup' AND k < 3)), r AS (SELECT DISTINCT event_type AS net, k FROM e),
 s AS (SELECT n AS arm, net, k FROM r, range(50) t(n) WHERE (ascii(net) + k * 7 + n * 3) % 11 < 1 + n % 4)
SELECT CAST(arm AS BIGINT) AS arm, count(DISTINCT (s.net, s.k)) AS requests, count(DISTINCT user_id) AS "found" FROM s LEFT JOIN f ON f.net = s.net AND f.k = s.k GROUP BY arm""")
def next_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that each of 50 sets of requests (event type and k) would find together, but for those known by early signups."""
    e, c = events(spark, sf_dir), F.col
    finds = e.select(c("event_type").alias("net"), "k", "user_id")
    arms = spark.range(50).withColumnRenamed("id", "arm")
    requests = finds.select("net", "k").distinct()  # a few hundred
    sets = requests.crossJoin(F.broadcast(arms)).filter((F.ascii("net") + c("k") * 7 + c("arm") * 3) % 11 < 1 + c("arm") % 4)
    return unions.union_sizes(finds, ["net", "k"], ["user_id"], sets, "arm", e.filter((c("event_type") == "signup") & (c("k") < 3)).select("user_id"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, '$.turns[' || i || '].role' AS path, md5(role) AS text FROM t WHERE role IS NOT NULL UNION ALL SELECT conv_id, '$.turns[' || i || '].said.text', md5(text) FROM t WHERE text IS NOT NULL
UNION ALL SELECT conv_id, '$.turns[' || i || '].said.words[' || j || '][0]', md5(w[j + 1]) FROM (SELECT conv_id, i, string_split(text, ' ') AS w, unnest(range(len(string_split(text, ' ')))) AS j FROM t WHERE i = 0) UNION ALL SELECT DISTINCT conv_id, '$."a name"', md5('conversation ' || conv_id) FROM t""")
def conversation_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with their paths of conversations that are written as nested JSON, with numbers, nulls and lists of lists in it."""
    c = F.col
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    words = lambda x, i: F.when(i == 0, F.transform(F.split(x["text"], " "), lambda w: F.array(w)))
    turns = F.transform("t", lambda x, i: F.struct(x["turn"].alias("number"), x["role"].alias("role"), F.struct(x["text"].alias("text"), words(x, i).alias("words")).alias("said")))
    body = F.to_json(F.struct(turns.alias("turns"), F.concat(F.lit("conversation "), c("conv_id").cast("string")).alias("a name"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    return documents.json_strings(rows.select("conv_id", body.alias("body")), "conv_id", "body").withColumn("text", F.md5("text"))


LETTERS = "[CASE WHEN {} THEN '\\' || c[i] ELSE c[i] END for i in range(1, len(c) + 1)]"
_FENCE = "coalesce(c[i{}] in ('`', '~'), false)"
_AT = [_FENCE.format(x) for x in (" - 2", " - 1", "", " + 1", " + 2")]
#: Rules that look at neighbours go letter by letter, as DuckDB's patterns can't look around.
SAFE_STEPS = [
    ("letters", "c[i] = '[' AND (coalesce(c[i + 1] = '[', false) OR (i > 1 AND c[i - 1] = '['))"), ("pattern", r"!\[", r"!\\["), ("letters", "c[i] = '%' AND (coalesce(c[i + 1] = '%', false) OR (i > 1 AND c[i - 1] = '%'))"),
    ("letters", f"{_AT[2]} AND (({_AT[3]} AND {_AT[4]}) OR (i > 1 AND {_AT[1]} AND {_AT[3]}) OR (i > 2 AND {_AT[0]} AND {_AT[1]}))"),
    ("pattern", r"`(\s*\$?)=", r"\\`\1\\="), ("pattern", "<([/!?%a-zA-Z])", r"&lt;\1"), ("pattern", r"(?m)^(\s*)#", r"\1\\#"), ("pattern", r"(?m)^(\s*[-*+] )\[", r"\1\\["), ("pattern", r"(?i)\]\(\s*(javascript|data):", r"]\\(\1:"),
]


def safe_sql() -> str:
    sql = "SELECT doc_id, text AS t FROM documents"
    for kind, *rule in SAFE_STEPS:
        if kind == "letters":
            sql = f"SELECT doc_id, array_to_string({LETTERS.format(rule[0])}, '') AS t FROM (SELECT doc_id, CASE WHEN t IS NOT NULL THEN string_split(t, '') END AS c FROM ({sql}))"
        else:
            sql = f"SELECT doc_id, regexp_replace(t, '{rule[0]}', '{rule[1]}', 'g') AS t FROM ({sql})"
    return sql


@query(f"SELECT doc_id, md5(t) AS safe, length(t) AS n FROM ({safe_sql()})")
def safe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = notes.sanitized(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", safe.alias("t")).select("doc_id", F.md5("t").alias("safe"), F.length("t").cast("long").alias("n"))


BUDGETS, CREDITS = {"view": 6, "click": 5, "purchase": 4, "signup": 9}, 7


def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of a line's day: clicks and purchases are metered, some replies say that a limit is reached."""
    c = F.col
    cost = F.when(c("event_type").isin("click", "purchase"), 1 + c("k") % 2).otherwise(0)
    return events(spark, sf_dir).select("line", "day", "event_id", c("event_type").alias("net"), (c("k") % 3).cast("string").alias("adapter"), cost.alias("cost"), (c("value") < 2).alias("limited"))


@query()
def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with why it is held back; a plain loop over the same rows is in the tests."""
    return admission.admitted(request_rows(spark, sf_dir), ["line", "day"], "event_id", BUDGETS, CREDITS, frozenset({"signup/2"}))
