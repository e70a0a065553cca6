"""Ball k-means against plain rounds over all centroids, in Python's whole numbers."""

import hashlib
import math
import random

import duckdb

from lookback.llm import ballmeans

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"
MOST = (1 << 63) - 1


def plainly(rows: list[tuple], k: int, rounds: int, dims: int, scale: int = 1024, seed: int = 3) -> list[tuple]:
    fine = [(i, [math.floor(x * scale) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in fine if i is not None)
    c = [v for _, v in named[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        at = [min((apart(v, p), j) for j, p in enumerate(c)) for _, v in fine] if c else []
        if turn < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, b) in zip(fine, at) if b == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    if not c:
        return []
    one = {j: sum(d for d, b in at if b == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in c]
    return sorted(((-1 if i is None else i), j, min(d, MOST), min(one[j], MOST), min(sum(one.values()), MOST), sha[j]) for (i, _), (d, j) in zip(fine, at))


def found(df) -> list[tuple]:
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def made(spark, rows):
    return spark.createDataFrame([(i, v, "other", 1) for i, v in rows], SCHEMA).repartition(3)


def single(x: float) -> float:
    import numpy as np

    return float(np.float32(x))


def balls(rng: random.Random, n: int, dims: int, width: float) -> list[tuple]:
    """Vectors around three far centres, with ties, repeats, and what takes no part."""
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(3)]
    rows = [(k, [single(x + rng.uniform(-width, width)) for x in rng.choice(centres)]) for k in range(n)]
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, rows[5][1]), (None, None), (900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1)), (905, [None] + [0.0] * (dims - 1))]
    return rows + [(1000 + k, [0.0] * dims) for k in range(40)]


def test_equals_plain_rounds(spark):
    rows = balls(random.Random(2), 300, 6, 1.2)
    assert found(ballmeans.ball_k_means(made(spark, rows), 5, 4, dims=6)) == plainly(rows, 5, 4, 6)


def test_members_of_stable_cores_are_not_compared(spark):
    rows = balls(random.Random(4), 300, 6, 0.02)
    got = ballmeans.ball_k_means(made(spark, rows), 4, 4, dims=6)
    assert found(got) == plainly(rows, 4, 4, 6)
    n = got.count()
    assert got.first()["computed"] < 0.7 * n * 4 * 5


def test_numbers_of_any_size(spark):
    rng = random.Random(6)
    rows = [(k, [single(rng.choice([1e-30, 1.0, 3e6, 1e15, 3e38]) * rng.uniform(-1, 1)) for _ in range(3)]) for k in range(40)]
    assert found(ballmeans.ball_k_means(made(spark, rows), 3, 3, dims=3)) == plainly(rows, 3, 3, 3)


def test_few_or_no_vectors(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.25, 0.5]), (None, [9.0, 9.0])]
    assert found(ballmeans.ball_k_means(made(spark, rows), 8, 2, dims=2)) == plainly(rows, 8, 2, 2)
    assert ballmeans.ball_k_means(made(spark, [(1, None), (2, [1.0])]), 8, 2, dims=2).collect() == []
    assert ballmeans.ball_k_means(made(spark, []), 8, 2, dims=2).collect() == []


def test_equals_sql(spark):
    rows = balls(random.Random(8), 200, 6, 0.8)
    table = made(spark, rows)
    c = duckdb.connect()
    c.register("embeddings", table.toArrow())
    names = "coalesce(vec_id, -1), cluster, distance, cluster_inertia, inertia, centroid_sha256"
    assert found(ballmeans.ball_k_means(table, 4, 3, dims=6)) == sorted(c.execute(f"SELECT {names} FROM ({ballmeans.lloyd_sql(4, 3, 6)})").fetchall())


def test_rounds_do_not_shuffle_vectors(spark):
    table = made(spark, balls(random.Random(9), 50, 4, 0.5))
    blocks, *_ = ballmeans.write_blocks(ballmeans.fit_vectors(table, 4), 1024.0, 4, 4)
    centroids = [[0, 0, 0, 0], [900, 0, 0, 0]]
    state, *_ = ballmeans.save(ballmeans.assign(blocks, None, centroids, None), "assignments", 4)
    plan = ballmeans.assign(blocks, state, centroids, ballmeans.neighbours(centroids, [1 << 40] * 2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
