"""Canonical JSON, forms of wordings, states built anew."""

import hashlib
import json

from pyspark.sql import functions as F

from lookback.functions import states, wording
from lookback.operators import rebuild


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_canonical_json_is_that_of_sorted_keys(spark):
    odd = 'a\x1f\x0b\x7f\\u000B\\\\u001F\n\t\b"/é漢😀 '
    rows = [(odd, {"q10": 1, "q2": None, "q1": 3}, [("x", None), None], (None, True), {"b": [("y", "z")], "a": []}), (None, None, None, None, None)]
    schema = "zz string, m map<string,int>, l array<struct<b:string,a:string>>, n struct<x:int,B:boolean>, o map<string,array<struct<b:string,a:string>>>"
    df = states.with_json(spark.createDataFrame(rows, schema), "j", F.struct("zz", "m", "l", "n", "o"))
    pairs = lambda xs: None if xs is None else [x and {"b": x[0], "a": x[1]} for x in xs]
    for row, got in zip(rows, df.collect()):
        zz, m, l, n, o = row
        want = {"zz": zz, "m": m, "l": pairs(l), "n": n and {"x": n[0], "B": n[1]}, "o": o and {k: pairs(v) for k, v in o.items()}}
        assert got["j"] == canonical(want)


def test_states_have_the_fields_that_were_hashed(spark):
    text = "word " * 1_000
    df = spark.createDataFrame([("t", "u", "paper", None, text, ["e"], "c", "b")], "title string, url string, adapter string, published date, text string, evidence array<string>, claim string, brief string")
    c = F.col
    shown = states.source(c("title"), c("url"), c("adapter"), c("published"), c("text"), F.lit(2_500), F.lit(2_510))
    line, asked = states.line(F.lit("l"), F.array(F.lit("v"))), states.question(c("title"), c("brief"))
    source = {"title": "t", "url": "u", "adapter": "paper", "published": None, "excerpt": "… " + text[1505:3505] + " …"}
    q, ln = {"title": "t", "brief": "b"}, {"name": "l", "vocabulary": ["v"]}
    wants = [
        (states.triage(line, states.full_source(c("title"), c("url"), c("adapter"), c("text"))), {"line": ln, "source": {"title": "t", "url": "u", "adapter": "paper", "text": text}}),
        (states.trust(shown), {"source": source}),
        (states.detection(asked, c("claim"), c("title")), {"question": q, "unit": {"text": "c", "source_title": "t"}}),
        (states.novelty(asked, c("claim"), c("evidence")), {"question": q, "claim": "c", "evidence_set": ["e"]}),
        (states.support(c("claim"), shown), {"claim": "c", "source": source}),
        (states.movement(asked, c("evidence"), c("evidence")), {"question": q, "today": ["e"], "evidence_set": ["e"]}),
        (states.claim_rubric(line, c("claim"), shown, F.lit(None).cast("string"), c("evidence")), {"line": ln, "claim": "c", "source": source, "report_context": None, "stored_similar": ["e"]}),
        (states.report_rubric(line, c("claim"), c("evidence")), {"line": ln, "prose": "c", "claims": ["e"]}),
        (states.report_rubric(line, c("claim"), c("evidence"), c("evidence")), {"line": ln, "prose": "c", "claims": ["e"], "known": ["e"]}),
        (states.fidelity(c("title"), c("claim"), c("evidence")), {"question": "t", "paragraph": "c", "claims": ["e"]}),
        (states.ordering(line, c("claim")), {"line": ln, "claim": "c"}),
    ]
    for made, want in wants:
        got = states.with_json(df, "j", made).select("j", states.input_hash(F.col("j")).alias("h")).first()
        assert got["j"] == canonical(want) and got["h"] == hashlib.sha256(canonical(want).encode()).hexdigest()


def test_forms_of_a_wording():
    today = wording.Wording("screen", "v2", "Read `source`.", {"b": 1, "a": {"d": 1, "c": 2}}, {"x": ["lo", "hi"]}, "w2")
    assert today.sha256 == hashlib.sha256(canonical({"function": "screen", "version": "v2", "instructions": "Read `source`.", "schema": {"b": 1, "a": {"d": 1, "c": 2}}, "levels": {"x": ["lo", "hi"]}, "wire": "w2"}).encode()).hexdigest()
    listed = wording.forms(today, ("w1", None, "w2"), "source", "All {subject}s.", [wording.Wording("screen", "v1", "Read.", {}, {}, "w2"), today])
    assert [(f[2], f[3], f[4]) for f in listed] == [(k, v, e) for e, v in ((False, "v2"), (True, "v1")) for k, v in (("today", v), ("batched", f"{v}_batch"), *[("legacy", v), ("legacy_batched", f"{v}_batch")] * 2)]
    assert len({f[1] for f in listed}) == len(listed)
    assert today.batched("source", "All {subject}s.").instructions == "Read every `sources.sN`.\n\nAll sources."


def test_answers_under_unknown_wordings_are_null(spark):
    today, before = wording.Wording("f", "v2", "a", {}), wording.Wording("f", "v1", "b", {})
    forms = wording.form_table(spark, wording.forms(today, before=[before]))
    judged = spark.createDataFrame([(1, "f", today.sha256, 0.1), (2, "f", before.sha256, 0.2), (3, "f", "0" * 64, 0.3), (4, "g", today.sha256, 0.4), (5, "f", None, 0.5)], "id int, function string, bundle_sha256 string, p double")
    got = {r["id"]: (r["p"], r["form"], r["earlier"]) for r in rebuild.readable(judged, forms, ["p"]).collect()}
    assert got == {1: (0.1, "today", False), 2: (None, "today", True), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}
    assert {r["id"]: r["p"] for r in rebuild.readable(judged, forms, ["p"], earlier=True).collect()} == {1: 0.1, 2: 0.2, 3: None, 4: None, 5: None}


def test_the_first_variant_that_matches_counts(spark):
    rows = spark.createDataFrame([("s", "x"), ("t", "x"), ("t", "y"), ("u", None)], "subject string, v string")
    variants = rebuild.tried(rows, {"one": F.struct(F.col("v").alias("b"), F.lit(1).alias("a")), "same": F.struct(F.lit(1).alias("a"), F.col("v").alias("b")), "never": F.struct(F.lit(None).cast("string").alias("z"))})
    h = lambda v: hashlib.sha256(canonical(v).encode()).hexdigest()
    judged = spark.createDataFrame([("j1", "s", h({"a": 1, "b": "x"})), ("j2", "s", h({"a": 1, "b": "y"})), ("j3", "t", h({"a": 1, "b": "y"})), ("j4", "u", h({"z": None})), ("j5", "w", None)], "judgment string, subject string, state_sha256 string")
    found = rebuild.rebuilt(judged, variants, ["subject"])
    assert {r["judgment"]: (r["variant"], r["state"]) for r in found.collect()} == {"j1": ("one", '{"a":1,"b":"x"}'), "j2": (None, None), "j3": ("one", '{"a":1,"b":"y"}'), "j4": ("never", '{"z":null}'), "j5": (None, None)}
    assert tuple(rebuild.share_rebuilt(found.withColumn("all", F.lit(1)), ["all"]).first()) == (1, 3, 5, 0.6)
