"""Queries over stored judgments: states built anew, orders of questions, known wordings.

Stand-ins: a document is a judged source; what was recorded of it is the hash of JSON that is put together by hand, in both
engines, of one of the variants that the operator tries, or of none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import states, wording
from ..operators import rebuild
from ..sources import scan
from .queries import EVENTS, events
from .registry import query, table

QUESTIONS = [{"title": "Does it hold?", "brief": "What was measured", "method": ["trial", "survey"], "evidence": ["numbers"], "not": ["opinion", "ad \"x\""]}, {"title": "What is new?", "brief": "Since last year", "method": [], "evidence": [], "not": []}]
OLDER = "What was measured in 2023"


def compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def quoted(c: Column) -> Column:
    """A text as JSON."""
    text = F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(6), F.length(text) - 6)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as judged sources, with the variant of their state that was recorded (4: one that nobody tries)."""
    c = F.col
    published = F.when(c("doc_id") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 28).cast("int")))
    named = dict(title=F.left("text", F.lit(20)), url=F.concat(F.lit("https://example.org/d/"), c("doc_id").cast("string")), published=published, asked=c("doc_id") % 2, recorded=(c("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars", *[v.alias(k) for k, v in named.items()])


def view_by_hand() -> Column:
    text = F.when(F.length("text") <= 2000, F.col("text")).otherwise(F.concat(F.left("text", F.lit(2000)), F.lit(" …")))
    parts = [("adapter", "source"), ("excerpt", text), ("published", F.col("published").cast("string")), ("title", "title"), ("url", "url")]
    listed = [x for name, c in parts for x in (F.lit(f',"{name}":'), quoted(F.col(c) if isinstance(c, str) else c))]
    return F.concat(F.lit("{"), F.substr(F.concat(*listed), F.lit(2)), F.lit("}"))


def recorded_hash() -> Column:
    kind, c = F.col("recorded"), F.col
    evidence = F.when(kind == 1, F.lit("[]")).otherwise(F.concat(F.lit("["), quoted(F.concat(F.lit("known "), c("lang"))), F.lit(","), quoted(F.concat(F.lit("of "), c("n_chars").cast("string"))), F.lit("]")))
    words = F.when(kind == 3, F.lit("[]")).otherwise(F.concat(F.lit("["), quoted(c("source")), F.lit(","), quoted(c("lang")), F.lit("]")))
    older = F.when(c("asked") == 0, compact(QUESTIONS[0] | {"brief": OLDER})).otherwise(compact(QUESTIONS[1] | {"brief": OLDER}))
    asked = F.when(kind == 2, older).otherwise(F.when(c("asked") == 0, compact(QUESTIONS[0])).otherwise(compact(QUESTIONS[1])))
    state = F.concat(F.lit('{"evidence_set":'), evidence, F.lit(',"line":{"name":'), quoted(c("lang")), F.lit(',"vocabulary":'), words, F.lit('},"question":'), asked, F.lit(',"source":'), view_by_hand(), F.lit("}"))
    return F.when(kind == 4, F.sha2(F.concat(F.lit("lost:"), c("doc_id").cast("string")), 256)).otherwise(F.sha2(state, 256))


def literal_question(q: dict) -> Column:
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.struct(*[(texts(v) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in q.items()])


def screening_variants() -> dict[str, Column]:
    c = F.col
    shown = states.source(c("title"), c("url"), c("source"), c("published"), c("text"))
    now = F.when(c("asked") == 0, literal_question(QUESTIONS[0])).otherwise(literal_question(QUESTIONS[1]))
    before = F.when(c("asked") == 0, literal_question(QUESTIONS[0] | {"brief": OLDER})).otherwise(literal_question(QUESTIONS[1] | {"brief": OLDER}))
    known, none = F.array(F.concat(F.lit("known "), c("lang")), F.concat(F.lit("of "), c("n_chars").cast("string"))), F.array().cast("array<string>")
    line, bare = states.line(c("lang"), F.array("source", "lang")), states.line(c("lang"), none)
    return {"today": states.screening(line, now, shown, known), "no_evidence": states.screening(line, now, shown, none), "earlier_question": states.screening(line, before, shown, known), "no_vocabulary": states.screening(bare, now, shown, known)}


def states_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources(spark, sf_dir)
    judged = rows.select("doc_id", "source", recorded_hash().alias("state_sha256"))
    return rebuild.rebuilt(judged, rebuild.tried(rows, screening_variants()), ["doc_id"], "doc_id")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


J = "coalesce(CAST(to_json({}) AS VARCHAR), 'null')"
SOURCES = f"""WITH s AS (SELECT doc_id, text, lang, source, n_chars, doc_id % 2 AS asked, doc_id % 5 AS recorded, substr(text, 1, 20) AS title, 'https://example.org/d/' || doc_id AS url,
  CASE WHEN doc_id % 3 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS VARCHAR) END AS published, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 2000) || ' …' END AS excerpt FROM documents),
 w AS (SELECT *, '{{"adapter":' || {J.format("source")} || ',"excerpt":' || {J.format("excerpt")} || ',"published":' || {J.format("published")} || ',"title":' || {J.format("title")} || ',"url":' || {J.format("url")} || '}}' AS view FROM s)"""


def screening_sql(kind: str) -> str:
    """The state of one variant, by its number."""
    return f"""('{{"evidence_set":' || CASE WHEN {kind} = 1 THEN '[]' ELSE '[' || {J.format("'known ' || lang")} || ',' || {J.format("'of ' || n_chars")} || ']' END || ',"line":{{"name":' || {J.format("lang")} || ',"vocabulary":' ||
  CASE WHEN {kind} = 3 THEN '[]' ELSE '[' || {J.format("source")} || ',' || {J.format("lang")} || ']' END || '}},"question":' || CASE WHEN {kind} = 2 THEN CASE WHEN asked = 0 THEN {sql_text(compact(QUESTIONS[0] | {"brief": OLDER}))} ELSE {sql_text(compact(QUESTIONS[1] | {"brief": OLDER}))} END
  WHEN asked = 0 THEN {sql_text(compact(QUESTIONS[0]))} ELSE {sql_text(compact(QUESTIONS[1]))} END || ',"source":' || view || '}}')"""


FOUND = SOURCES + f""", j AS (SELECT doc_id, CASE WHEN recorded = 4 THEN sha256('lost:' || doc_id) ELSE sha256({screening_sql("recorded")}) END AS h FROM w),
 v AS (SELECT doc_id, k, {screening_sql("k")} AS state FROM w, range(4) r(k)),
 m AS (SELECT j.doc_id, arg_min(['today', 'no_evidence', 'earlier_question', 'no_vocabulary'][k + 1], k) AS variant, arg_min(state, k) AS state FROM j JOIN v ON j.doc_id = v.doc_id AND j.h = sha256(v.state) GROUP BY j.doc_id)"""


@query(FOUND + " SELECT doc_id, variant, md5(state) AS state FROM documents LEFT JOIN m USING (doc_id)")
def states_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states_found(spark, sf_dir).select("doc_id", "variant", F.md5("state").alias("state"))


@query(FOUND + " SELECT source, count(state) AS hit, count(*) AS tried, round(count(state) / count(*), 6) AS share FROM documents LEFT JOIN m USING (doc_id) GROUP BY source")
def rebuild_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild.share_rebuilt(states_found(spark, sf_dir), ["source"]).withColumn("share", F.round("share", 6))


#: Versions of a question file, the newest first.
VERSIONS = [[("q1", "One", "a", ["x"]), ("q2", "Two", "b", [])], [("q1", "One", "a", []), ("q2", "Two", "b", []), ("q3", "Three", "c", ["y", "z"])], [("q3", "Three", "c", []), ("q1", "One", "older", []), ("q2", "Two", "b", [])]]


def prefilter_json(version: int) -> str:
    return compact({f"q{i}": {"title": t, "brief": b, "not": n} for i, (_, t, b, n) in enumerate(VERSIONS[version])})


ORDERS = SOURCES + f""", j AS (SELECT *, CAST(2 + doc_id % 2 AS INTEGER) AS n, CAST(doc_id % 28 AS INTEGER) AS day, '{{"line":{{"name":' || {J.format("lang")} || ',"vocabulary":[' || {J.format("source")} || ']}},"questions":' AS head, ',"source":' || view || '}}' AS tail FROM w),
 h AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id % 8 = 3 THEN 2 ELSE 9 END AS made FROM j),
 q AS (SELECT * FROM (VALUES {", ".join(f"({i}, {len(v)}, {sql_text(prefilter_json(i))}, '{','.join(x[0] for x in v)}')" for i, v in enumerate(VERSIONS))}) t(place, size, questions, ids)),
 g AS (SELECT h.*, sha256(CASE WHEN made = 9 THEN 'lost:' || doc_id ELSE head || q.questions || tail END) AS stored FROM h LEFT JOIN q ON q.place = made),
 f AS (SELECT doc_id, arg_min(ids, place) AS ids FROM g JOIN q ON q.size = g.n AND sha256(head || q.questions || tail) = stored GROUP BY doc_id)"""


@query(ORDERS + " SELECT doc_id, CASE WHEN day % 7 = 1 AND n = 2 THEN 'r1,r2' ELSE ids END AS asked FROM h LEFT JOIN f USING (doc_id)")
def prefilter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = sources(spark, sf_dir).withColumns({"n": (2 + c("doc_id") % 2).cast("int"), "day": (c("doc_id") % 28).cast("int")})
    made = F.when(c("doc_id") % 4 == 0, prefilter_json(0)).when(c("doc_id") % 4 == 1, prefilter_json(1)).when(c("doc_id") % 8 == 3, prefilter_json(2))
    state = F.concat(F.lit('{"line":{"name":'), quoted(c("lang")), F.lit(',"vocabulary":['), quoted(c("source")), F.lit(']},"questions":'), made, F.lit(',"source":'), view_by_hand(), F.lit("}"))
    judged = rows.withColumn("state_sha256", F.sha2(F.coalesce(state, F.concat(F.lit("lost:"), c("doc_id").cast("string"))), 256))
    versions = spark.createDataFrame([(i, [(a, t, b, n) for a, t, b, n in v]) for i, v in enumerate(VERSIONS)], "place int, questions array<struct<id:string,title:string,brief:string,`not`:array<string>>>")
    recorded = rows.filter((c("day") % 7 == 1) & (c("n") == 2)).select("day", "n", F.array(F.lit("r1"), F.lit("r2")).alias("asked")).distinct()
    line, shown = states.line(c("lang"), F.array("source")), states.source(c("title"), c("url"), c("source"), c("published"), c("text"))
    found = rebuild.recovered_orders(judged, recorded, versions, line, shown, "doc_id")
    return found.select("doc_id", F.array_join("asked", ",").alias("asked"))


# wordings


def spec(function: str, version: str = "v2", text: str = "Judge each `source` by itself.") -> wording.Wording:
    return wording.Wording(function, version, text, {"type": "object", "properties": {"p": {"type": "integer"}}}, {"p": ["no", "some", "full"]}, "wire-3")


NOTE, WIRES = "Several {subject}s at once.", ("wire-2", None)


def known_forms() -> list[tuple]:
    return [f for name in ("view", "click", "purchase") for f in wording.forms(spec(name), WIRES, "source", NOTE, [spec(name, "v1", "Judge the `source`.")])]


def form_json(function: str, version: str, text: str, wire: str | None) -> str:
    return compact({"function": function, "version": version, "instructions": text, "schema": {"type": "object", "properties": {"p": {"type": "integer"}}}, "levels": {"p": ["no", "some", "full"]}} | ({"wire": wire} if wire else {}))


BATCHED = "Judge each every `sources.sN` by itself.\n\nSeveral sources at once."
#: What judgments carry, by event_id % 6: the JSON whose hash names the wording.
CARRIED = [("v2", "Judge each `source` by itself.", "wire-3"), ("v2_batch", BATCHED, "wire-3"), ("v2", "Judge each `source` by itself.", None), ("v1", "Judge the `source`.", "wire-2"), ("v1", "Judge each `source` by itself.", "wire-3"), ("v2", "Another wording", "wire-3")]
CARRIED_AS = [("today", "false"), ("batched", "false"), ("legacy", "false"), ("legacy", "true"), None, None]


@query(EVENTS + f""", j AS (SELECT event_type AS function, CAST(event_id % 6 AS INTEGER) AS c, value FROM e), d AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x[0]}', {x[1]})" for i, x in enumerate(CARRIED_AS) if x)}) t(c, form, earlier)),
 r AS (SELECT function, d.form, d.earlier, j.c, value FROM j LEFT JOIN d ON d.c = j.c AND function IN ('view', 'click', 'purchase'))
SELECT function, form, earlier, count(*) AS judgments, count(*) FILTER (form IS NOT NULL AND NOT earlier) AS read_today, count(form) AS read_any, round(avg(value) FILTER (form IS NOT NULL AND NOT earlier), 6) AS mean FROM r GROUP BY 1, 2, 3""")
def known_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    carried = F.element_at(F.array(*[F.concat(F.lit(form_json("\0", *x).split("\\u0000")[0]), F.col("event_type"), F.lit(form_json("\0", *x).split("\\u0000")[1])) for x in CARRIED]), (F.col("event_id") % 6 + 1).cast("int"))
    judged = events(spark, sf_dir).select(F.col("event_type").alias("function"), F.sha2(carried, 256).alias("bundle_sha256"), F.col("value").alias("today"), F.col("value").alias("any"))
    forms = wording.form_table(spark, known_forms())
    found = rebuild.readable(rebuild.readable(judged, forms, ["any"], earlier=True).drop("form", "earlier"), forms, ["today"])
    return found.groupBy("function", "form", "earlier").agg(F.count("*").alias("judgments"), F.count("today").alias("read_today"), F.count("any").alias("read_any"), F.round(F.avg("today"), 6).alias("mean"))


FETCHED = EVENTS + """, f AS (SELECT event_id, day, event_type, user_id % 40 AS u, CASE WHEN event_id % 4 = 3 THEN sha256('gone ' || event_id) ELSE
  sha256('{"adapter":"' || event_type || '","net":"keyword","query":"words of ' || user_id % 40 || CASE WHEN event_id % 4 = 2 THEN ' older' ELSE '' END || '","run_date":"' || day || '"}') END AS key FROM e)"""


@query(FETCHED + " SELECT event_id, CASE WHEN event_id % 4 < 2 AND event_type <> 'error' THEN event_type END AS adapter, CASE WHEN event_id % 4 < 2 AND event_type <> 'error' THEN 'words of ' || u END AS text FROM f")
def named_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, text = F.col, lambda s: F.lit(s)
    e = events(spark, sf_dir)
    words = F.concat(text("words of "), (c("user_id") % 40).cast("string"), F.when(c("event_id") % 4 == 2, " older").otherwise(""))
    body = F.concat(text('{"adapter":"'), c("event_type"), text('","net":"keyword","query":"'), words, text('","run_date":"'), c("day").cast("string"), text('"}'))
    key = F.when(c("event_id") % 4 == 3, F.sha2(F.concat(text("gone "), c("event_id").cast("string")), 256)).otherwise(F.sha2(body, 256))
    asked = e.filter("event_type <> 'error'").select(c("event_type").alias("adapter"), F.concat(text("words of "), (c("user_id") % 40).cast("string")).alias("text"))
    return rebuild.named_fetches(e.select("event_id", key.alias("input_sha256")), asked, e.select("day")).select("event_id", "adapter", "text")


#: Documents as asks: their text's first letters are the state, so that many ask alike; those of every third state are stored.
ASKED = """WITH a AS (SELECT doc_id, lang, lower(substr(coalesce(text, ''), 1, 2)) AS state FROM documents), s AS (SELECT DISTINCT lang, state FROM a WHERE ascii(state || ' ') % 3 = 0)"""


@query(ASKED + " SELECT doc_id, CASE WHEN s.state IS NOT NULL THEN s.state || '!' END AS answer FROM a LEFT JOIN s ON s.lang IS NOT DISTINCT FROM a.lang AND s.state = a.state")
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay_parts(spark, sf_dir)[0].select(F.col("ask").alias("doc_id"), "answer")


@query(ASKED + " SELECT a.lang, a.state, count(*) AS waiting FROM a LEFT JOIN s ON s.lang IS NOT DISTINCT FROM a.lang AND s.state = a.state WHERE s.state IS NULL GROUP BY 1, 2")
def open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replay_parts(spark, sf_dir)[1]
    return found.select(F.element_at("subjects", 1).alias("lang"), F.col("state_sha256").alias("state"), "waiting")


def replay_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    asks = table(spark, sf_dir, "documents").select(c("doc_id").alias("ask"), F.lit("screen").alias("function"), F.array("lang").alias("subjects"), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 2)).alias("state_sha256"))
    # stored under the second form where the state's letter is even, else under the first
    form = F.when(F.ascii(F.concat("state_sha256", F.lit(" "))) % 2 == 0, "batched").otherwise("single")
    known = asks.filter(F.ascii(F.concat("state_sha256", F.lit(" "))) % 3 == 0).select("function", "subjects", "state_sha256").distinct()
    stored = known.select(rebuild.judgment_id(c("function"), c("subjects"), F.lit("m"), c("state_sha256"), form).alias("judgment"), F.concat("state_sha256", F.lit("!")).alias("answer"))
    bundles = spark.createDataFrame([("screen", 0, "single"), ("screen", 1, "batched")], "function string, place int, bundle_sha256 string")
    return rebuild.replayed(asks, stored, bundles, "m")


@query()
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all pages, as documents of three kinds of which long ones aren't read; how scans go on is in the tests."""
    c = F.col
    kind = F.element_at(F.array(*map(F.lit, scan.PLACES)), (c("page_id") % 3 + 1).cast("int"))
    path = F.concat(F.element_at(F.split("url", "/"), 3), F.lit("/"), c("page_id").cast("string"), F.lit(".md"))
    files = table(spark, sf_dir, "pages").select(path.alias("path"), kind.alias("kind"), F.when(F.length("html") <= 30_000, F.concat("url", F.lit(" "), "html")).alias("text"))
    made = scan.scan(files, files.filter(F.endswith("path", F.lit("7.md"))).select("path"), own_mark="track(1)")
    return made.found.join(made.tainted.withColumn("unsure", F.lit(True)), "key", "left").select("key", "place", "path", F.coalesce("unsure", F.lit(False)).alias("unsure"))
