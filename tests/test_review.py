"""Hand-counted weeks, and admission against a plain loop."""

import datetime as dt
import os

import pytest

from lookback.operators import review
from lookback.plans import arms

D = lambda n: dt.date(2026, 9, 7) + dt.timedelta(n)  # noqa: E731  day 0 is a Monday
SF = "/root/testdata/sf0.001"


def test_reviews_that_show_again(spark):
    shown = spark.createDataFrame([("a", D(0)), ("a", D(2)), ("b", D(1)), ("c", D(8)), ("a", D(9)), ("c", D(8))], "k string, day date")
    posted = spark.createDataFrame([("b", D(0)), ("c", D(10)), ("d", D(0))], "k string, day date")
    got = {r["week"]: (r["entries"], r["repeats"]) for r in review.review_repeats(shown, posted, ["k"], "day").collect()}
    assert got == {D(0): (3, 2), D(7): (3, 1)}  # a again, b after its note; then a


def test_author_signal(spark):
    rows = [
        ("l", "p1", "correct", "source", False, D(1)), ("l", "p1", "correct", "claim", False, D(9)), ("m", "p1", "correct", "source", False, D(20)),
        ("l", "p2", "correct", "source", False, D(2)), ("l", "p2", "correct", "claim", False, None), ("l", "p3", "wrong", "source", False, D(1)),
        ("l", None, "correct", "question_day", True, D(3)), ("l", None, "wrong", "question_day", True, D(8)), ("l", None, "correct", "question_day", False, D(3)), ("l", None, "correct", "source", True, D(3)),
    ]
    labels = spark.createDataFrame(rows, "line string, paper string, verdict string, provenance string, log boolean, first date")
    weeks = spark.createDataFrame([(D(-7),), (D(0),), (D(7),), (D(21),)], "week date")
    got = {r["week"]: (r["ticks"], r["positives"], r["added"], r["unknown"]) for r in review.author_signal(labels, weeks).collect()}
    assert got == {D(-7): (0, 1, 0, 1), D(0): (1, 2, 1, 1), D(7): (1, 2, 1, 1), D(21): (0, 3, 1, 1)}


def test_exceptions_and_rows(spark):
    frame = spark.createDataFrame
    lines = frame([(D(0), "a", 0), (D(0), "b", 3), (D(7), "a", 1)], "week date, line string, count int")
    cells = frame([(D(0), "x", "missing"), (D(0), "x", "stuck"), (D(0), "y", "live"), (D(7), "x", "expected-zero")], "week date, instrument string, status string")
    questions = frame([(D(0), "q", None), (D(0), "r", True), (D(14), "q", False)], "week date, question string, moved boolean")
    found = review.exceptions(lines, cells, questions)
    assert {r["week"]: (r["zero_lines"], r["failing"], r["stuck"], r["exceptions"]) for r in found.collect()} == {D(0): (1, 1, 1, 3), D(7): (0, 0, 0, 0), D(14): (0, 0, 1, 1)}
    other = frame([(D(0), 5, "é"), (D(21), 6, None)], "week date, b int, a string")
    rows = {r["week"]: r["row"] for r in review.review_rows({"z": found, "other": other}).collect()}
    assert rows[D(0)] == '{"other":{"a":"é","b":5},"week":"2026-09-07","z":{"exceptions":3,"failing":1,"stuck":1,"zero_lines":1}}'
    assert rows[D(21)] == '{"other":{"a":null,"b":6},"week":"2026-09-28","z":null}' and len(rows) == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="the shared tables aren't here")
def test_admission_equals_a_plain_loop(spark):
    rows = sorted((tuple(r) for r in arms.request_rows(spark, SF).collect()), key=lambda r: r[:3])
    want, state = {}, {}
    for line, day, i, net, adapter, cost, limited in rows:
        s = state.setdefault((line, day), {"sent": {}, "spent": 0, "quiet": {"signup/2"}, "pool": False})
        if f"{net}/{adapter}" in s["quiet"]:
            why = "quiet"
        elif cost and s["pool"]:
            why = "pool quiet"
        elif s["sent"].get(net, 0) >= arms.BUDGETS.get(net, 0):
            why = "budget"
        elif cost and s["spent"] >= arms.CREDITS:
            why = "credits"
        else:
            why = None
            s["sent"][net] = s["sent"].get(net, 0) + 1
            s["spent"] += cost
            if limited:
                if cost:
                    s["pool"] = True
                else:
                    s["quiet"].add(f"{net}/{adapter}")
        want[i] = why
    got = {r["event_id"]: r["held"] for r in arms.admitted_requests(spark, SF).collect()}
    assert got == want and set(want.values()) == {None, "quiet", "pool quiet", "budget", "credits"}
