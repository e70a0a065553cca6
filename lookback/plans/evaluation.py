"""Queries over rules, policies, intake and the trust in measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, statistics
from ..operators import evaluation, health, measures, routing
from .queries import EVENTS, HEALTH, PAIRS, cells_of, events, hashed, hashed_sql, outcome_sql, pairs
from .registry import query, table

W = "(0.5 * overlap + 0.3 * strength + 0.2 * novelty)"
GATES = "(on_topic >= 0.5 AND method >= 0.3 AND evidence >= 0.3)"


@query(PAIRS + f"""SELECT doc_id, {GATES} AND {W} >= 0.6 AS screen_accept, trust >= 0.8 AS bridge_accept, CASE WHEN novelty < 0.34 OR overlap < 0.34 THEN 'duplicate' WHEN strength < 0.1 THEN 'unjudged' ELSE 'novel' END AS verdict,
 method >= 0.34 AS moved, least(on_topic, evidence, trust, method) >= 0.5 AS rubric_accept, round(least(on_topic, evidence, trust, method), 6) AS rubric_score, trust >= 0.5 AND method >= 0.5 AND injection < 0.7 AS report_accept,
 round(least(trust, method, 1 - injection), 6) AS report_score, injection < 0.7 AS faithful, CASE WHEN {W} < 0.6 THEN printf('borderline %.2f < 0.60', {W}) ELSE printf('low certainty %.2f < 0.50', least(strength, overlap)) END AS reason FROM p""")
def more_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, c, policy = pairs(spark, sf_dir), F.col, routing.Policy()
    score = routing.weighted(c("overlap"), c("strength"), c("novelty"))
    decided = F.array(routing.decide(c("novelty"), c("novelty") >= 0.34, F.lit(False)), routing.decide(c("overlap"), c("overlap") >= 0.34, F.lit(False)), routing.decide(c("strength"), F.lit(True), c("strength") < 0.1))
    axes, report = routing.all_axes(c("on_topic"), c("evidence"), c("trust"), c("method")), routing.report_rubric(c("trust"), c("method"), c("injection"))
    return p.select(
        "doc_id", routing.accept_screen(routing.gates(c("on_topic"), c("method"), c("evidence"), policy), score, policy)["accept"].alias("screen_accept"), routing.bridge(c("trust"), policy)["accept"].alias("bridge_accept"),
        routing.novelty_verdict(decided).alias("verdict"), routing.moved(c("method"), policy)["accept"].alias("moved"), axes["accept"].alias("rubric_accept"), F.round(axes["score"], 6).alias("rubric_score"),
        report["accept"].alias("report_accept"), F.round(report["score"], 6).alias("report_score"), routing.fidelity(c("injection"))["accept"].alias("faithful"), routing.review_reason(score, F.least("strength", "overlap"), policy).alias("reason"),
    )


@query(EVENTS + """, r AS (SELECT line, day, count(*) FILTER (event_type = 'error') AS failed, min(event_id) FILTER (event_type = 'error') AS first, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS claims, count(*) FILTER (event_type = 'signup' AND value > 30) AS cited, count(*) FILTER (event_type = 'view' AND value < 5) AS unverified FROM e GROUP BY 1, 2),
 b AS (SELECT *, lag(cited) OVER (PARTITION BY line ORDER BY day) AS before FROM r)
SELECT line, day, array_to_string([x for x in [CASE WHEN failed > 0 THEN printf('prose failed %d/%d drafts (%s)', failed, n, substr('call ' || first || repeat(' failed', 20), 1, 120)) END, CASE WHEN unverified > 0 THEN printf('prose unverified (rubric judge failed) in %d section(s)', unverified) END, CASE WHEN failed / n >= 0.2 THEN printf('unjudged %d/%d pairs (%d%%)', failed, n, CAST(round_even(failed / n * 100, 0) AS INTEGER)) END,
 CASE WHEN claims = 0 THEN 'empty note (no claim, no review)' END, CASE WHEN cited = 0 AND before = 0 THEN 'no citation 2 runs in a row' END, CASE WHEN n > 40 THEN 'cost cap reached (partial note)' END] if x IS NOT NULL], '; ') AS reasons FROM b""")
def health_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import with_previous

    kind, c = F.col("event_type"), F.col
    runs = events(spark, sf_dir).groupBy("line", "day").agg(F.count_if(kind == "error").alias("failed"), F.count("*").alias("n"), F.count_if(kind == "purchase").alias("claims"), F.count_if((kind == "signup") & (c("value") > 30)).alias("cited"), F.count_if((kind == "view") & (c("value") < 5)).alias("unverified"), F.array_sort(F.collect_list(F.when(kind == "error", c("event_id")))).alias("calls"))
    said = F.transform("calls", lambda i: F.concat(F.lit("call "), i.cast("string"), F.lit(" failed" * 20)))
    runs, zero, no = with_previous(runs, ["line"], "day", "cited"), F.lit(0), F.lit(False)
    run = dict(writer_refused=no, failed_drafts=said, drafts=c("n"), unverified=c("unverified"), failed_pairs=c("failed"), pairs=c("n"), questions=F.lit(1), claims=c("claims"), review=zero, cited=c("cited"), previous_cited=c("previous"), failed_fetches=F.array().cast("array<string>"), capped=c("n") > 40)
    return runs.select("line", "day", F.array_join(routing.health_reasons(run, 0.2), "; ").alias("reasons"))


@query(PAIRS + f""", s AS (SELECT doc_id // 3 AS pair, {GATES} AS g, {W} AS w, least(strength, overlap) AS sure FROM p),
 r AS (SELECT *, CASE WHEN NOT g OR w < 0.5 THEN 0 WHEN w >= 0.7 THEN 2 WHEN w < 0.6 OR sure < 0.5 THEN 1 ELSE 2 END AS r FROM s)
SELECT pair, ['drop', 'review', 'keep'][max(r) + 1] AS route, round(max(w) FILTER (g), 6) AS best FROM r GROUP BY pair""")
def best_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    screens = pairs(spark, sf_dir).withColumn("pair", F.expr("doc_id div 3")).withColumn("sure", F.least("strength", "overlap"))
    return evaluation.best_screens(screens, ["pair"], routing.Policy()).withColumn("best", F.round("best", 6))


ENTRIES = EVENTS + f""", n AS (SELECT event_id AS item, day, line, event_type AS question, user_id AS source, k AS key, {hashed_sql("event_id", "a")} * 0.6 AS pa, {hashed_sql("event_id", "b")} * 0.5 AS pc, {hashed_sql("event_id", "c")} AS ch, {hashed_sql("event_id", "d")} AS nov FROM e),
 fq AS (SELECT question, key, min(day) AS f FROM n GROUP BY 1, 2), fl AS (SELECT line, key, min(day) AS f FROM n GROUP BY 1, 2),
 m AS (SELECT n.*, fq.f < day AS kq, fl.f < day AS kl, least(pa + pc, ch) AS score FROM n JOIN fq ON n.question = fq.question AND n.key = fq.key JOIN fl ON n.line = fl.line AND n.key = fl.key)"""


def shown_sql(name: str, bears: float, new_first: bool) -> str:
    order = ("kq, " if new_first else "") + "score DESC, item"
    return f""", {name}p AS (SELECT *, least(5, greatest(2, 9 // (SELECT count(DISTINCT question) FROM m x WHERE x.line = m.line AND x.day = m.day AND pa + pc >= {bears} AND ch >= 0.5 AND nov >= 0.34))) AS cap FROM m WHERE pa + pc >= {bears} AND ch >= 0.5 AND nov >= 0.34),
 {name}s AS (SELECT *, row_number() OVER (PARTITION BY line, day, question, source ORDER BY {order}) AS i FROM {name}p), {name}r AS (SELECT *, row_number() OVER (PARTITION BY line, day, question ORDER BY {order}) AS j FROM {name}s WHERE i <= 2), {name} AS (SELECT * FROM {name}r WHERE j <= cap)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = events(spark, sf_dir), F.col
    rows = e.select(c("event_id").alias("item"), "day", "line", c("event_type").alias("question"), c("user_id").alias("source"), c("k").alias("key"), *[hashed(c("event_id"), n).alias(f"_{n}") for n in "abcd"])
    rows = rows.select("item", "day", "line", "question", "source", "key", (c("_a") * 0.6).alias("p_advances"), (c("_b") * 0.5).alias("p_contradicts"), c("_c").alias("p_checkable"), c("_d").alias("novelty"))
    return evaluation.with_scores(rows)


@query(ENTRIES + shown_sql("u", 0.5, True) + " SELECT item FROM u")
def shown_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.shown(entries(spark, sf_dir), routing.Policy(), new_first=True).select("item")


SIDES = ", ".join(f"CAST(sum(coalesce({k}{s}, 0)) AS BIGINT) AS {n}_{w}" for k, n in (("s", "shown"), ("n", "new"), ("q", "newq")) for s, w in (("u", "now"), ("v", "then")))


@query(ENTRIES + shown_sql("u", 0.5, False) + shown_sql("v", 0.7, True) + "".join(f", {x}d AS (SELECT line, day, count(*) AS s{x}, count(DISTINCT key) FILTER (NOT kl) AS n{x}, count(DISTINCT (question, key)) FILTER (NOT kq) AS q{x} FROM {x} GROUP BY 1, 2)" for x in "uv")
       + f""" SELECT count(*) AS days, {SIDES}, count(*) FILTER (coalesce(nv, 0) > coalesce(nu, 0)) AS better, count(*) FILTER (coalesce(nv, 0) < coalesce(nu, 0)) AS worse FROM (SELECT DISTINCT line, day FROM m) LEFT JOIN ud USING (line, day) LEFT JOIN vd USING (line, day)""")
def shown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.shown_score(entries(spark, sf_dir), (routing.Policy(), False), (routing.Policy().with_(bears_on=0.7), True))


@query(ENTRIES + shown_sql("u", 0.5, False) + """, d AS (SELECT m.line, m.question, m.key, m.day, bool_or(u.item IS NOT NULL) AS s, bool_or(m.pa + m.pc >= 0.5 AND m.ch >= 0.5 AND m.nov >= 0.34) AS p FROM m LEFT JOIN u ON m.item = u.item GROUP BY 1, 2, 3, 4),
 f AS (SELECT line, question, key, arg_min(CASE WHEN s THEN 'shown' WHEN p THEN 'cut' ELSE 'dup' END, day) AS stratum FROM d GROUP BY 1, 2, 3) SELECT line, stratum, count(*) AS n FROM f GROUP BY 1, 2""")
def entry_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.strata(entries(spark, sf_dir), ["line", "question", "key"], routing.Policy())
    return found.groupBy("line", "stratum").agg(F.count("*").alias("n"))


@query(PAIRS + f""", o AS (SELECT *, {outcome_sql()} AS o, CASE WHEN {GATES} THEN {W} END AS best FROM p)
SELECT CASE WHEN o = 'prefilter' THEN CASE WHEN on_topic >= 0.3 THEN 'pf-near' ELSE 'pf-far' END WHEN o = 'safe' THEN 'safe' WHEN best IS NULL THEN 'gate' WHEN best >= 0.7 THEN 'high' WHEN best >= 0.6 THEN 'band-high' WHEN best >= 0.5 THEN 'band-low' ELSE 'low' END AS stratum,
 count(*) AS n, count(gold) AS labelled FROM o GROUP BY 1""")
def pair_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, policy = F.col, routing.Policy()
    p = routing.staged_outcome(pairs(spark, sf_dir), policy, "now")
    best = F.when(routing.gates(c("on_topic"), c("method"), c("evidence"), policy), routing.weighted(c("overlap"), c("strength"), c("novelty")))
    return p.groupBy(evaluation.band(c("now"), c("on_topic"), best).alias("stratum")).agg(F.count("*").alias("n"), F.count("gold").alias("labelled"))


@query(EVENTS + """, l AS (SELECT line, day, user_id AS source, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS rank, CASE WHEN event_type = 'view' THEN 0 ELSE -value END AS s, event_id AS place FROM e WHERE event_type <> 'error'),
 o AS (SELECT line, day, source, min((rank, s, place)) AS o FROM l GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY line, day ORDER BY o, source) AS slot FROM o) SELECT line, day, source, CAST(slot AS INTEGER) AS slot FROM r WHERE slot <= 7""")
def listing_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm, c = evaluation.Arm(cap=7, off=("error",)), F.col
    sent = events(spark, sf_dir).filter(arm.sends(c("event_type"), F.lit(None).cast("string")))
    listed = sent.select("line", "day", c("user_id").alias("source"), F.when(c("event_type") == "view", 0).otherwise(1).alias("rank"), F.when(c("event_type") != "view", c("value")).alias("score"), c("event_id").alias("place"))
    return evaluation.listing_cut(listed, arm, "line", "day")


REACHED = EVENTS + f""", r AS (SELECT day, user_id AS source, event_type AS via, k AS key, value >= 5 AS ok, CASE WHEN value < 45 THEN greatest({hashed_sql("user_id", "a")}, {hashed_sql("user_id", "b")}) >= 0.5 END AS passes, CASE WHEN k % 4 <> 0 THEN day - k % 9 END AS published FROM e WHERE day >= DATE '2024-01-05'),
 o AS (SELECT DISTINCT k AS key FROM e WHERE day < DATE '2024-01-05' AND value > 40)"""


def reached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, c = events(spark, sf_dir), F.col
    verdict = evaluation.source_verdict(F.array(hashed(c("user_id"), "a"), hashed(c("user_id"), "b")))
    found = e.filter("day >= '2024-01-05'").select("day", c("user_id").alias("source"), c("event_type").alias("via"), c("k").alias("key"), (c("value") >= 5).alias("chars_ok"), F.when(c("value") < 45, verdict["passes"]).alias("passes"), F.when(c("k") % 4 != 0, F.date_sub("day", c("k") % 9)).alias("published"))
    return found, e.filter("day < '2024-01-05' AND value > 40").select(c("k").alias("key"))


@query(REACHED + """, n AS (SELECT r.key, count(DISTINCT day) AS u, min(day) - min(published) AS d FROM r ANTI JOIN o ON r.key = o.key WHERE ok AND passes GROUP BY 1), p AS (SELECT count(*) FILTER (u = 1) AS once, count(*) FILTER (u = 2) AS twice, median(d) AS delay, count(*) AS s FROM n),
 x AS (SELECT count(DISTINCT source) AS reached, count(DISTINCT source) FILTER (ok) AS screened, count(DISTINCT source) FILTER (ok AND passes IS NULL) AS unjudged, count(DISTINCT r.key) AS keys,
 count(DISTINCT r.key) FILTER (o.key IS NULL) AS keys_new, count(DISTINCT r.key) FILTER (o.key IS NULL AND ok AND passes) AS passed_new, count(DISTINCT day) AS days FROM r LEFT JOIN o ON r.key = o.key)
SELECT x.*, delay, once, twice, round(s / days, 6) AS passed_a_day, CASE WHEN days >= 10 THEN round(CASE WHEN once = 0 THEN s WHEN twice > 0 THEN s + (days - 1) / days * once * once / (2 * twice) ELSE s + (days - 1) / days * once * (once - 1) / 2 END, 6) END AS chao2 FROM x, p""")
def intake_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.intake_score(*reached(spark, sf_dir))
    return found.withColumns({n: F.round(n, 6) for n in ("passed_a_day", "chao2")})


@query(REACHED + "SELECT r.key, min(day) AS first_day, array_to_string(list_sort(list_distinct(list(via))), ',') AS vias FROM r ANTI JOIN o ON r.key = o.key WHERE ok AND passes GROUP BY 1")
def new_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.new_finds(*reached(spark, sf_dir)).withColumn("vias", F.array_join("vias", ","))


@query(EVENTS + "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM e) WHERE i <= CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 3 ELSE 0 END")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.request_plan(events(spark, sf_dir), "event_type", "event_id", {"view": 5, "click": 3}).select("event_id", "event_type")


@query(PAIRS + f"SELECT source, doc_id, round(d, 6) AS distance FROM (SELECT source, doc_id, abs({W} - 0.6) AS d, row_number() OVER (PARTITION BY source ORDER BY abs({W} - 0.6), doc_id) AS i FROM p) WHERE i = 1 ORDER BY d, source LIMIT 10")
def nearest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = pairs(spark, sf_dir).withColumn("distance", routing.review_distance(routing.weighted(c("overlap"), c("strength"), c("novelty")), routing.Policy()))
    return evaluation.nearest_reviews(rows, "source", "doc_id", "distance").select("source", "doc_id", F.round("distance", 6).alias("distance"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, octet_length(encode(text)) // 3 + 1 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 b AS (SELECT conv_id, turn, tokens, i, 0 AS batch, tokens AS used, 1 AS n FROM t WHERE i = 1 UNION ALL
  SELECT t.conv_id, t.turn, t.tokens, t.i, batch + CASE WHEN used + t.tokens > 350 OR n = 3 THEN 1 ELSE 0 END, CASE WHEN used + t.tokens > 350 OR n = 3 THEN t.tokens ELSE used + t.tokens END, CASE WHEN used + t.tokens > 350 OR n = 3 THEN 1 ELSE n + 1 END FROM b JOIN t ON t.conv_id = b.conv_id AND t.i = b.i + 1)
SELECT conv_id, turn, tokens, CAST(batch AS INTEGER) AS batch FROM b""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", keys.estimated_tokens(F.col("text")).alias("tokens"))
    return evaluation.token_batches(rows, ["conv_id"], "turn", "tokens", 400, 50, 3)


# the weekly review


@query(EVENTS + """, l AS (SELECT line, count(*) FILTER (event_type = 'view') AS free, count(*) AS slots, count(DISTINCT user_id) AS users FROM e GROUP BY line)
SELECT 'all' AS "group", count(*) AS lines, CAST(sum(users) AS BIGINT) AS users FROM l UNION ALL SELECT CASE WHEN free / slots <= 0.3 THEN 'slot' ELSE 'supply' END, count(*), CAST(sum(users) AS BIGINT) FROM l GROUP BY 1""")
def groups_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = events(spark, sf_dir).groupBy("line").agg(F.count_if(F.col("event_type") == "view").alias("free"), F.count("*").alias("slots"), F.count_distinct("user_id").alias("users"))
    return measures.groups_of_lines(lines, "line", "free", "slots", ["users"])


@query(EVENTS + "SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS place FROM (SELECT event_type, count(*) AS n FROM e GROUP BY 1)")
def delivery_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.reasons(events(spark, sf_dir), "event_type")


@query(EVENTS + """, v AS (SELECT line, CASE WHEN value < 10 THEN 'used' WHEN value < 30 THEN 'unused' WHEN value < 40 THEN 'pending' ELSE 'unknown' END AS v FROM e)
SELECT line, count(*) FILTER (v = 'used') AS used, count(*) FILTER (v = 'unused') AS unused, count(*) FILTER (v = 'pending') AS pending, count(*) FILTER (v = 'unknown') AS unknown,
 round(count(*) FILTER (v = 'used') / nullif(count(*) FILTER (v IN ('used', 'unused')), 0), 6) AS rate FROM v GROUP BY line""")
def used_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    marks = events(spark, sf_dir).withColumn("verdict", F.when(v < 10, "used").when(v < 30, "unused").when(v < 40, "pending").otherwise("unknown"))
    return measures.used_rate(marks, ["line"]).withColumn("rate", F.round("rate", 6))


@query(EVENTS + """, a AS (SELECT DISTINCT day, user_id FROM e WHERE event_type = 'click'), b AS (SELECT DISTINCT day, user_id FROM e WHERE event_type = 'view')
SELECT coalesce(a.day, b.day) AS day, count(*) FILTER (a.day IS NULL) AS missed, count(*) FILTER (b.day IS NULL) AS extra FROM a FULL JOIN b ON a.day = b.day AND a.user_id = b.user_id GROUP BY 1""")
def replay_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return measures.self_check(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "day", ["user_id"])


@query(EVENTS + """, s AS (SELECT user_id, day, count(*) FILTER (value > 40) AS fresh FROM e WHERE event_type <> 'error' GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS i FROM s),
 m AS (SELECT user_id, sum(fresh) AS t, count(*) AS n FROM l WHERE i <= 5 GROUP BY 1), q AS (SELECT user_id, count(*) FILTER (event_type <> 'view') / 10.0::DOUBLE AS a, count(*) FILTER (event_type = 'view') / 10.0::DOUBLE AS b FROM e GROUP BY 1),
 r AS (SELECT a, b, n, coalesce(t / n, 0) AS m, coalesce(((b - a) / n) ** 2 * (t + 0.5::DOUBLE), 0) AS v FROM q LEFT JOIN m USING (user_id)),
 z AS (SELECT sum(a * m) AS x, sum(b * m) AS y, 1.959963984540054::DOUBLE * sqrt(sum(v)) AS h, sum(a - b) AS freed, count(*) FILTER (n IS NULL AND a > 0) AS missing_now, count(*) FILTER (n IS NULL AND b > 0) AS missing_then FROM r)
SELECT round(x, 4) AS now, round(y, 4) AS "then", round(y - x, 4) AS change, round(y - x - h, 4) AS low, round(y - x + h, 4) AS high, round(freed, 4) AS freed, missing_now, missing_then FROM z""")
def rotation_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = events(spark, sf_dir), F.col("event_type")
    yields = e.filter(kind != "error").groupBy("user_id", "day").agg(F.count_if(F.col("value") > 40).alias("fresh"))
    now, then = (e.filter(c).groupBy("user_id").agg(F.count("*").alias("sends")) for c in (kind != "view", kind == "view"))
    found = measures.rotation_estimate(yields, "user_id", "day", "fresh", now, then, runs=10)
    return found.select(*[F.round(c, 4).alias(c) for c in ("now", "then", "change", "low", "high", "freed")], "missing_now", "missing_then")


@query(EVENTS + """, b AS (SELECT user_id, k, max(value) / 50 AS best, min(event_type) AS arm, max(event_type) AS other FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
SELECT user_id, k, arm, round(best, 6) AS best FROM b WHERE arm = other AND best < 0.5 + 0.1""")
def boundary_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type IN ('click', 'view')").select(F.struct("user_id", "k").alias("key"), "event_type", (F.col("value") / 50).alias("p"))
    return measures.boundary(rows, "key", "event_type", "p", 0.5).select("key.user_id", "key.k", "arm", F.round("best", 6).alias("best"))


@query("SELECT median(CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS DOUBLE)) AS median_days, count(*) FILTER (CAST(l_shipdate AS DATE) > DATE '1995-01-01') AS late FROM lineitem")
def judging_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", F.lit("1995-01-01").cast("date").alias("seen"))
    return measures.delays(rows, "l_shipdate", "seen")


@query(PAIRS + "SELECT doc_id, round(greatest(abs(on_topic - method), abs(trust - 0), abs(0 - novelty)), 6) AS drift FROM p")
def answer_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    before, after = F.create_map(F.lit("yes"), c("on_topic"), F.lit("no"), c("trust")), F.create_map(F.lit("yes"), c("method"), F.lit("other"), c("novelty"))
    return pairs(spark, sf_dir).select("doc_id", F.round(measures.drift(before, after), 6).alias("drift"))


@query(PAIRS + """, x AS (SELECT doc_id, on_topic * 10 - 5 AS t, on_topic * 10 - 6 AS lo, on_topic * 10 - 4 AS hi, trust * 0.1 AS p, CASE WHEN novelty > 0.1 THEN method * 2 END AS f FROM p)
SELECT doc_id, CASE WHEN f IS NULL THEN 'unmeasured' WHEN (lo > 0 OR hi < 0) AND p < 0.05 AND abs(t) > f THEN 'difference' WHEN lo > 0 OR hi < 0 OR p < 0.05 THEN 'borderline' ELSE 'undetermined' END AS verdict,
 CASE WHEN hi < 0 THEN 'FAIL' WHEN f IS NULL THEN 'PASS-PARTLY' ELSE 'PASS' END AS gate FROM x""")
def difference_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    total, p, floor = c("on_topic") * 10 - 5, c("trust") * 0.1, F.when(c("novelty") > 0.1, c("method") * 2)
    low, high = c("on_topic") * 10 - 6, c("on_topic") * 10 - 4
    return pairs(spark, sf_dir).select("doc_id", statistics.difference_verdict(total, low, high, p, floor).alias("verdict"), statistics.gate_verdict(high < 0, floor.isNull()).alias("gate"))


@query(HEALTH + """, d AS (SELECT * FROM s WHERE status IN ('missing', 'contradiction', 'stuck', 'unexplained-zero')) SELECT event_type, count(DISTINCT line) AS doubted,
 ['missing', 'contradiction', 'unexplained-zero', 'stuck'][min(list_position(['missing', 'contradiction', 'unexplained-zero', 'stuck'], status))] AS worst, bool_or(n > 0) AS some FROM d GROUP BY 1""")
def caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.caveats(cells_of(spark, sf_dir), "n", ["event_type"])


@query(HEALTH + " SELECT event_type, status, count(*) AS n, min(day) AS first_day FROM s GROUP BY 1, 2")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.status_counts(cells_of(spark, sf_dir).select("event_type", "status", "day"), ["event_type"])


@query(EVENTS + """SELECT event_id, isodow(CAST(ts - INTERVAL 5 HOURS AS DATE)) >= 6 OR CAST(ts - INTERVAL 5 HOURS AS DATE) - 1 IN (DATE '2024-01-01', DATE '2024-01-15') AS listing, isodow(CAST(ts AS DATE) - 1) >= 6 AS daily FROM e""")
def quiet_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts")
    return events(spark, sf_dir).select("event_id", health.listing_quiet(at, ["2024-01-01", "2024-01-15"]).alias("listing"), health.daily_quiet(at).alias("daily"))


@query(EVENTS + """SELECT event_id, CASE WHEN k = 3 AND value > 25 THEN 'rate_limit' WHEN k = 3 THEN 'forbidden' WHEN k = 6 THEN 'not_acceptable' WHEN k = 9 THEN 'rate_limit' ELSE 'error' END AS kind,
 CASE WHEN event_type = 'error' THEN 'forbidden' END AS read, round((k * 3.0 + user_id * 15.0) / 1000000, 8) AS usd FROM e""")
def request_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("k"), F.col("value")
    status = F.when(k == 3, 403).when(k == 6, 406).when(k == 9, 429).otherwise(500)
    detail = F.when(F.col("event_type") == "error", F.lit("403 forbidden: rate_limit")).otherwise(F.concat(F.lit("500 oops: "), F.col("event_type")))
    return events(spark, sf_dir).select("event_id", keys.status_kind(status, F.lit(None).cast("string"), F.when(v > 25, F.lit("0"))).alias("kind"), keys.failure_kind(detail).alias("read"), F.round(keys.usage_price(k, F.col("user_id"), F.lit(3.0), F.lit(15.0)), 8).alias("usd"))


@query(EVENTS + """, l AS (SELECT value, k FROM e WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1)
SELECT 'value' AS axis, round(avg(value / 100.0), 6) AS mean_score FROM l UNION ALL SELECT 'step', round(avg(k / 10.0), 6) FROM l UNION ALL SELECT 'gold_agreement', CAST(NULL AS DOUBLE)""")
def rubric_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {"value": F.col("value") / 100.0, "step": F.col("k") / F.lit(10.0), "gold_agreement": F.lit(None).cast("double")}
    asked = events(spark, sf_dir).filter("event_type <> 'error'")
    found = measures.axis_meters(asked, ["user_id", "k"], [F.col("ts"), F.col("event_id")], axes)
    return found.withColumn("mean_score", F.round("mean_score", 6))


@query(EVENTS + """, g AS (SELECT line, user_id, day, list_sort(list(DISTINCT k) FILTER (event_type = 'click' AND k IS NOT NULL)) AS a, list_sort(list(DISTINCT k) FILTER (event_type = 'purchase' AND k IS NOT NULL)) AS b
 FROM e WHERE event_type IN ('click', 'purchase') GROUP BY ALL) SELECT line, count(*) FILTER (a IS NOT DISTINCT FROM b) AS hit, count(*) AS tried FROM g GROUP BY line""")
def section_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    same = measures.same_sets(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ["line", "user_id", "day"], "k")
    return measures.tallies(same, ["line"], F.col("same"))


@query(PAIRS + " SELECT source, count(*) FILTER (method >= 0.5 AND evidence >= 0.3) AS hit, count(*) AS tried FROM p GROUP BY source")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.tallies(pairs(spark, sf_dir), ["source"], (F.col("method") >= 0.5) & (F.col("evidence") >= 0.3))
