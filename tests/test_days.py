"""Day replay against a plain loop, posterior intervals against plain draws."""

import datetime as dt
import random

import numpy as np
import pytest

from lookback.operators import days, posterior
from lookback.operators.evaluation import Arm

D0 = dt.date(2024, 3, 1)
SCHEMA = "line string, day date, net string, adapter string, query string, via string, place int, pos int, source string, score double, chars int, judged_on date"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def cut(found: list[dict], room: int) -> list[dict]:
    """All that fits; else by score, where there is one; else the first."""
    if len(found) <= room:
        return found
    if any(r["score"] is not None for r in found):
        found = sorted(found, key=lambda r: float("inf") if r["score"] is None else -r["score"])
    return found[:room]


def plainly(rows: list[dict], when: list[dt.date], arm: Arm, back: int, start: dt.date) -> set:
    out = set()
    for line in {r["line"] for r in rows}:
        own, reached = [r for r in rows if r["line"] == line], set()
        for day in when:
            today = [r for r in own if r["day"] == day]
            others = [(r["source"], r["via"]) for r in today if r["net"] != "firehose" and r["net"] not in arm.off and r["query"] not in arm.dropped]
            got = []
            if "firehose" not in arm.off:
                listings = sorted((r for r in today if r["net"] == "firehose"), key=lambda r: ({"hf_papers": 0, "arxiv": 1}.get(r["adapter"], 2), r["place"], r["pos"]))
                seen: list[str] = []
                for key in dict.fromkeys((r["adapter"], r["place"]) for r in listings):
                    fresh = [r | {"score": r["score"] if r["adapter"] == "arxiv" else None} for r in listings if (r["adapter"], r["place"]) == key and r["source"] not in seen]
                    kept = cut(fresh, max(arm.cap - len(seen), 0))
                    seen += [r["source"] for r in kept]
                    got += [(r["source"], r["via"]) for r in kept]
                room = arm.cap - len(seen)
                if back and room > 0:
                    taken, pool = reached | {s for s, _ in got} | {s for s, _ in others}, {}
                    for past in sorted({r["day"] for r in own if day - dt.timedelta(back) <= r["day"] < day}, reverse=True):
                        for r in sorted((r for r in own if r["day"] == past and r["net"] == "firehose" and r["adapter"] == "arxiv"), key=lambda r: (r["place"], r["pos"])):
                            if r["source"] in taken or r["source"] in pool or r["chars"] < arm.least_chars:
                                continue
                            if r["day"] < start and (r["judged_on"] or dt.date.max) < start:
                                continue
                            pool[r["source"]] = r
                    got += [(r["source"], "backlog") for r in cut(list(pool.values()), room)]
            got += others
            out |= {(line, day, s, v) for s, v in got}
            reached |= {s for s, _ in got}
    return out


def history(seed: int, n_days: int = 60) -> list[dict]:
    rng, rows = random.Random(seed), []
    for line in ("a", "b", "c"):
        for d in range(n_days):
            place = 0
            for net, adapter in (("firehose", "arxiv"), ("firehose", "hf_papers"), ("keyword", "web"), ("citation", "web"), ("firehose", "arxiv"), ("firehose", "other")):
                if rng.random() < 0.45:
                    continue
                place += 1
                query = f"q{rng.randint(1, 4)}" if net == "keyword" else None
                for pos, s in enumerate(rng.sample(range(d * 2, d * 2 + 40), rng.choice([0, 1, 3, 9]))):
                    rows.append(dict(line=line, day=D0 + dt.timedelta(d), net=net, adapter=adapter, query=query, via=f"{adapter}:{query or place}", place=place, pos=pos, source=f"s{s}", score=None if line == "c" else round(rng.random(), 3), chars=rng.choice([50, 500, 900]), judged_on=rng.choice([None, D0, D0 + dt.timedelta(12)])))
    return rows


@pytest.mark.parametrize(("arm", "back"), [(Arm(cap=6), 0), (Arm(cap=8, off=("citation",), dropped=("q1",)), 7), (Arm(cap=8, off=("firehose",)), 7)])
def test_replay_equals_a_plain_loop(spark, arm, back):
    rows = history(3)
    when = [D0 + dt.timedelta(d) for d in range(8, 62)]  # days before and behind are in the table or not
    frame = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA).repartition(5)
    got = days.replay(frame, spark.createDataFrame([(d,) for d in when], "day date"), arm, back, when[0]).collect()
    want = plainly(rows, when, arm, back, when[0])
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    assert any(v == "backlog" for *_, v in want) == (back > 0 and not arm.off == ("firehose",))


def test_replay_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert days.replay(none, spark.createDataFrame([(D0,)], "day date"), Arm(cap=3), 7, D0).collect() == []


CELLS = [("s", False, False, 100, 10, 2), ("s", True, True, 50, 25, 20), ("s", False, True, 30, 0, 0), ("t", True, False, 20, 5, 5), ("t", True, True, 40, 20, 11)]
NAMES = ["stratum", "kept_now", "kept_then", "population", "labelled", "positive"]


def drawn(cells, top, bottom, n=200_000):
    """The same ratio by draws one cell after the other."""
    rng, total = np.random.default_rng(99), {}
    for s, *_, n_, r in cells:
        total[s] = (total.get(s, (0, 0))[0] + r, total.get(s, (0, 0))[1] + n_)
    borrowed = {s: rng.beta(0.5 + r, 0.5 + m - r, n) for s, (r, m) in total.items()}
    up = down = 0
    for (s, a, b, size, m, r), x, y in zip(cells, top, bottom):
        found = r + (size - m) * (rng.beta(0.5 + r, 0.5 + m - r, n) if m else borrowed[s])
        up, down = up + x * found, down + y * found
    return np.quantile(up / down, [0.025, 0.975])


def test_intervals_are_those_of_plain_draws(spark):
    rows = [("x", *c) for c in CELLS] + [("y", *c) for c in CELLS[:2]] + [("z", "s", True, True, 9, 0, 0)]
    frame = spark.createDataFrame(rows, "line string, stratum string, kept_now boolean, kept_then boolean, population long, labelled long, positive long")
    got = {(r["line"], r["name"]): r for r in posterior.estimates(frame, "line", seed=5).collect()}
    again = {(r["line"], r["name"]): r for r in posterior.estimates(frame.repartition(3), "line", seed=5).collect()}
    assert got == again and not any(line == "z" for line, _ in got)
    for name, side in (("recall_now", 1), ("recall_then", 2)):
        low, high = drawn(CELLS, [float(c[side]) for c in CELLS], [1.0] * len(CELLS))
        r = got["x", name]
        assert abs(r["low"] - low) < 0.01 and abs(r["high"] - high) < 0.01 and r["low"] < r["value"] < r["high"]
    y = [2 + 90 * 0.2, 20 + 25 * 0.8, 30 * 22 / 35, 5 + 15.0, 11 + 20 * 11 / 20]
    assert got["x", "recall_now"]["value"] == pytest.approx((y[1] + y[3] + y[4]) / sum(y))
    assert got["x", "precision_then"]["value"] == pytest.approx((y[1] + y[2] + y[4]) / 120)
    assert got["y", "recall_then"]["value"] == got["y", "recall_now"]["value"]


def test_a_stratum_without_labels_gives_null():
    import pandas as pd

    cells = pd.DataFrame([*CELLS, ("u", True, False, 7, 0, 0)], columns=NAMES)
    found = {name: v for name, v, *_ in posterior.label_ratios(cells, 1, 100)}
    assert found["recall_now"] is None and found["precision_now"] is None and found["recall_change"] is None
    assert found["precision_then"] is not None
    assert posterior.label_ratios(cells.assign(labelled=0, positive=0), 1) == []
