"""Strings of JSON without a schema, unions by bitmaps."""

import json
import random

from pyspark.sql import functions as F

from lookback.operators import unions
from lookback.sources import documents


def strings(value, path="$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from strings(v, f"{path}[{i}]")
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from strings(v, f"{path}.{k}" if k.isascii() and k.replace("_", "a").isalnum() else f'{path}."{k}"')


def test_strings_of_any_depth(spark):
    rng = random.Random(1)

    def made(depth):
        kind = rng.choice(["text", "text", "number", "null", "true"] if depth == 0 else ["list", "object", "text"])
        if kind == "list":
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        if kind == "object":
            return {k: made(depth - 1) for k in rng.sample(["a", "b_1", "odd name", "ü"], rng.randrange(4))}
        return {"text": "é\n\"x\"", "number": 1.5, "null": None, "true": True}[kind]

    values = [made(d) for d in range(7) for _ in range(6)] + ["alone", [], {}, None, 3, [[[[[[[[[["deep"]]]]]]]]]]]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)] + [(900, "{not json"), (901, None), (902, "")]
    got = sorted(tuple(r) for r in documents.json_strings(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect())
    assert got == sorted((i, p, t) for i, v in enumerate(values) for p, t in strings(v)) and len(got) > 40


def test_unions_equal_plain_sets(spark):
    rng = random.Random(2)
    finds = [(f"q{rng.randrange(20)}", rng.choice([None, *range(90_000)]), "x") for _ in range(4_000)]
    sets = [(s, f"q{q}") for s in range(50) for q in rng.sample(range(24), rng.randrange(1, 9))]
    known = [(k,) for k in range(0, 90_000, 3)]
    frame = spark.createDataFrame
    got = unions.union_sizes(frame(finds, "q string, k int, other string"), ["q"], ["k"], frame(sets + sets[:5], "s int, q string"), "s", frame(known, "k int")).collect()
    gone = {k for k, in known}
    of = {q: {k for x, k, _ in finds if x == q and k not in gone} for q in {x for x, *_ in finds}}
    want = {s: (len({q for t, q in sets if t == s}), len(set().union(*(of.get(q, set()) for t, q in sets if t == s)))) for s in range(50)}
    assert {r["s"]: (r["requests"], r["found"]) for r in got} == want
    none = unions.union_sizes(frame([], "q string, k int"), ["q"], ["k"], frame(sets, "s int, q string"), "s")
    assert none.agg(F.sum("found")).first()[0] == 0
