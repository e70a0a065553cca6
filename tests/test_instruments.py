"""The measurement registry on a hand-counted line, and that its plan reads each table once."""

import datetime as dt

from pyspark.sql import functions as F

from lookback.operators import instruments

D = lambda n: dt.date(2026, 9, 6) + dt.timedelta(n)  # noqa: E731  the 6th is a Sunday, day 1 a Monday
T = lambda n, h=6: dt.datetime(2026, 9, 6, h) + dt.timedelta(n)

RUNS = "line string, day date, started_at timestamp, report string, budget int, writer_calls int, tokens int, questions int, claims int"
STAGES = "line string, stage string, completed_at timestamp, outputs array<string>"
LOGS = "line string, day date, log string, logged_at timestamp, text string, claims array<string>"
LABELS = "label string, harvested_at timestamp, first_harvested_at timestamp, written date"


def scenario(spark, fault=None):
    """Five days, Monday to Friday, of one line: a section a day that cites one new source, one new tick, one opened note."""
    days = range(1, 6)
    runs = [("l", D(n), T(n), f"r{n}", 2, 1, 100 + n, 3, 2) for n in days]
    stages = [("l", s, T(n), ["x"] * (4 + n)) for n in days for s in (instruments.ARXIV, instruments.DAILY)]
    logs = [("l", D(n), f"q{n}", T(n), "It holds [1].", [f"c{n}"]) for n in days]
    sources = [(f"c{n}", f"s{n}") for n in range(1, 9)]
    labels = [(f"t{n}", T(n, 9), T(n, 9), D(n)) for n in days]
    opened = [(f"{D(n)}_line_l", D(n)) for n in days]
    if fault:
        fault(runs, stages, logs, sources, labels, opened)
    frame = spark.createDataFrame
    return {"runs": frame(runs, RUNS), "stages": frame(stages, STAGES), "logs": frame(logs, LOGS), "sources": frame(sources, "claim string, source string"), "labels": frame(labels, LABELS), "opened": frame(opened, "note string, day date"), "sightings": frame([("vault:x", D(2))], "place string, first_seen date")}


def cells_of(t):
    facts = [instruments.run_facts(t["runs"]), instruments.stage_facts(t["stages"]), instruments.log_facts(t["logs"], t["sources"]), instruments.label_facts(t["labels"], "2026-09-01"), instruments.opened_facts(t["opened"], "_line_"), instruments.sighting_facts(t["sightings"])]
    return instruments.readings(instruments.grouped(facts), instruments.registry([], "2026-09-01", "2026-09-09"))


def read(spark, fault=None):
    return {(r["instrument"], r["day"].day - 6): r for r in cells_of(scenario(spark, fault)).collect()}


def test_a_healthy_line(spark):
    got = read(spark)
    assert len(got) == 9 * 5  # no run sent a citation request
    status = lambda i: [got[i, n]["status"] for n in range(1, 6)]
    assert status("firehose.arxiv") == status("o1") == status("judge_tokens") == status("writer_calls") == status("label.first_harvest") == status("opened") == status("claims_posted") == ["live"] * 5
    # the list of the day before is empty on a Monday
    assert status("firehose.hf") == ["contradiction", "live", "live", "live", "live"]
    assert status("used.vault") == ["declared-degenerate", "live", "declared-degenerate", "unexplained-zero", "unexplained-zero"]
    assert [(got["o1", n]["value"], got["o1", n]["related"]) for n in (1, 2)] == [(1, None), (1, 1)]
    assert got["judge_tokens", 2]["related"] == 3 and got["writer_calls", 2]["related"] == 1 and got["firehose.arxiv", 2]["value"] == 6


def test_faults(spark):
    def fault(runs, stages, logs, sources, labels, opened):
        stages[:] = [s for s in stages if s[2] != T(3)] + [("l", instruments.CITING, T(2), [])]  # no fetch on Wednesday
        runs[1] = runs[1][:5] + (0, 0, 3, 2)  # Tuesday's calls and tokens are lost
        runs[3] = ("l", D(4), T(4), None, 2, None, None, None, None)  # no report on Thursday
        logs[2] = ("l", D(3), "q3", T(3), "It holds [1] and [2].", ["c1"])  # nothing new, and a claim that isn't there
        labels += [("late", T(5, 9), T(6, 9), D(5)), ("none", T(4, 9), None, D(2)), ("early", T(2, 9), T(1, 9), D(2))]
        opened += [("2026-09-30_line_l", D(1)), ("2026-09-08_review", D(1))]

    got = read(spark, fault)
    find = lambda i, n: (got[i, n]["value"], got[i, n]["status"], got[i, n]["conflict"])
    assert find("firehose.arxiv", 3) == (None, "missing", None) and ("citation", 1) not in got and find("citation", 2) == (0, "declared-degenerate", None)
    assert find("writer_calls", 2) == find("judge_tokens", 2) == (0, "contradiction", None)
    assert find("o1", 3) == (0, "contradiction", "q3 [2] resolves to no source")
    assert [find(i, 4) for i in ("o1", "claims_posted", "writer_calls", "judge_tokens")] == [(None, "missing", None)] * 4
    assert (got["o1", 5]["related"], got["claims_posted", 5]["related"]) == (0, 2)  # Thursday is skipped
    assert find("label.first_harvest", 5) == (1, "contradiction", "late: first harvest after the latest harvest")
    assert find("label.first_harvest", 4)[2] == "none: no first harvest on a note written since it is kept"
    assert find("label.first_harvest", 2)[2] == "early: first harvest before its note was written" and got["label.first_harvest", 1]["value"] == 2
    assert got["label.first_harvest", 6]["value"] == 1 and ("opened", 6) not in got  # a day that no run has
    assert find("opened", 1) == (2, "contradiction", "2026-09-30_line_l seen opened on 2026-09-07, before its own date")


def test_equal_values_are_stuck_and_a_second_zero_is_not_explained(spark):
    def fault(runs, stages, logs, sources, labels, opened):
        stages[:] = [("l", instruments.ARXIV, T(n), ["x"] * 7) for n in range(1, 6)]
        logs[1:] = []

    got = read(spark, fault)
    assert [got["firehose.arxiv", n]["status"] for n in range(1, 6)] == ["live", "live", "stuck", "stuck", "stuck"]
    assert [got["o1", n]["status"] for n in range(1, 6)] == ["live", "expected-zero", "unexplained-zero", "unexplained-zero", "unexplained-zero"]


def test_each_table_is_read_once(spark, tmp_path):
    tables = {}
    for name, df in scenario(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    plan = cells_of(tables)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == len(tables)
    assert cells_of(tables).filter(F.col("instrument") == "o1").count() == 5
