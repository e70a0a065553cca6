"""Centroid clustering by ball k-means (operator 13): clusters are balls, and only centroids of neighbour balls are compared."""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Vectors of a block, bytes of vectors in one bucket of the written table, and most buckets.
BLOCK, BUCKET_BYTES, BUCKETS = 1_024, 128 << 20, 50_000
#: Up to so large components, squared distances of 64 of them are exact in doubles; beyond, Python's numbers take over.
EXACT = 1 << 22
MOST = (1 << 63) - 1


def fit_vectors(embeddings: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """vec_id, v: the vectors of exactly so many components, none of them null or non-finite."""
    x = F.col(vector)
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, scale: float, seed: int) -> list[list[int]]:
    """The k vectors of least sha256('<seed>:<vec_id>') in ascending order; k rows come to the driver."""
    named = vectors.filter("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [[int(x) for x in np.floor(np.array(r["v"]) * scale)] for r in named.orderBy("h", "v").limit(k).collect()]


def save(df: DataFrame, name: str, buckets: int) -> tuple[DataFrame, str, str]:
    """A table in the shared folder, bucketed and sorted by block: joined with others like it, it isn't shuffled."""
    spark, path, own = df.sparkSession, shared.scratch(df.sparkSession, name), f"lookback_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, "block").sortBy("block").saveAsTable(own)
    return spark.table(own), own, path


def write_blocks(vectors: DataFrame, scale: float, dims: int, buckets: int) -> tuple[DataFrame, str, str]:
    """block, ids, matrix: whole numbers floor(scale * x) of up to BLOCK vectors, in single precision where that is exact."""

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in shared.row_steps(batch, BLOCK):
                values = part.column(1).flatten().to_numpy(zero_copy_only=False)
                whole = np.floor(values.astype(np.float64) * scale)
                narrow = bool((np.abs(whole) <= EXACT).all())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([whole.astype("<f4" if narrow else "<f8").tobytes()], pa.binary())], names=["block", "ids", "matrix"]
                )
                number += 1

    return save(vectors.mapInArrow(run, "block long, ids array<long>, matrix binary").repartition(buckets, "block"), "vectors", buckets)


def matrix_of(raw: bytes, rows: int, dims: int, narrow: bool) -> np.ndarray:
    """The block's numbers: doubles that are exact, or Python's numbers."""
    m = np.frombuffer(raw, "<f4" if len(raw) == rows * dims * 4 else "<f8").astype(np.float64).reshape(rows, dims)
    if narrow and len(raw) == rows * dims * 4:
        return m
    return np.array([[int(x) for x in r] for r in m], dtype=object).reshape(rows, dims)


def squared(m: np.ndarray, c: list[int]) -> np.ndarray:
    """Squared distances to a centroid, exact."""
    d = m - np.array(c, dtype=m.dtype)
    return (d * d).sum(axis=1) if m.dtype == object else np.einsum("ij,ij->i", d, d).astype(np.int64)


def nearest_of_all(m: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    d = np.stack([squared(m, c) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(m)), best]


def neighbours(centroids: list[list[int]], reach: list[int]) -> list[list[tuple[int, int]]]:
    """By cluster, (squared distance, number) of the centroids that can take one of its members, nearest first.

    Of a ball whose members are at most r away from the centroid, another centroid takes none that is more than 2r away.
    `reach` has squares of r.
    """
    apart = [[sum((x - y) ** 2 for x, y in zip(a, b)) for b in centroids] for a in centroids]
    return [sorted((d, i) for i, d in enumerate(row) if i != j and d <= 4 * reach[j]) for j, row in enumerate(apart)]


def nearest_in_balls(m: np.ndarray, centroids: list[list[int]], own: np.ndarray, near: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of vectors that were in cluster own, and how many distances were computed.

    A member nearer to its centroid than half the way to the nearest neighbour is in the stable core and stays. Others are
    in annuli: the t-th holds those that reach half the way to t neighbours, and only these t are compared. Ties go to the
    smaller number, so half the way itself is in the annulus.
    """
    best, least, computed = own.copy(), np.zeros(len(m), dtype=object if m.dtype == object else np.int64), 0
    for j in np.unique(own):
        rows = np.flatnonzero(own == j)
        ball = m[rows]
        distance = squared(ball, centroids[j])
        computed += len(rows)
        first, number = distance.copy(), np.full(len(rows), j)
        for d, i in near[j]:
            ring = np.flatnonzero(4 * first >= d)
            if not len(ring):
                break  # the next ones are further off
            other = squared(ball[ring], centroids[i])
            computed += len(ring)
            better = (other < distance[ring]) | ((other == distance[ring]) & (i < number[ring]))
            distance[ring[better]], number[ring[better]] = other[better], i
        best[rows], least[rows] = number, distance
    return best, least, computed


def sums_of(m: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int) -> list[str | None]:
    """By cluster: count, sum and maximum of squared distances, sum of each component, as text (null if it has no member)."""
    out: list[str | None] = [None] * k
    for j in np.unique(cluster):
        rows = cluster == j
        own = [int(d) for d in distance[rows]]
        out[int(j)] = ",".join(map(str, [len(own), sum(own), max(own), *(int(x) for x in m[rows].sum(axis=0))]))
    return out


def added(texts: list[str]) -> str:
    """One such text of several: all but the maximum, at place 2, are summed."""
    columns = list(zip(*[[int(p) for p in t.split(",")] for t in texts]))
    return ",".join(str(max(c) if i == 2 else sum(c)) for i, c in enumerate(columns))


def totals(state: DataFrame, k: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """By cluster: count, sum and maximum of squared distances, component sums. Tasks sum up first; k rows come to the driver."""

    def run(batches):
        own: dict[int, list[str]] = {}
        for batch in batches:
            for listed in batch.column(0).to_pylist():
                for j, text in enumerate(listed):
                    if text is not None:
                        own[j] = [added([*own.get(j, []), text])]
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([t[0] for t in own.values()], pa.string())], names=["cluster", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "sums": pa.array([added(table.column("sums").to_pylist())])})

    rows = state.select("sums").mapInArrow(run, "cluster int, sums string").groupBy("cluster").applyInArrow(merge, "cluster int, sums string").collect()
    out = {}
    for r in rows:
        n, inertia, most, *components = (int(p) for p in r["sums"].split(","))
        out[r["cluster"]] = n, inertia, most, components
    return out


def assign(blocks: DataFrame, state: DataFrame | None, centroids: list[list[int]], near: list | None) -> DataFrame:
    """block, clusters, distances, sums and computed (distances) of every block, from the state before."""
    sent = blocks.sparkSession.sparkContext.broadcast((centroids, near))  # k centroids
    k, dims = len(centroids), len(centroids[0])
    narrow = all(abs(x) <= EXACT for c in centroids for x in c)

    def run(batches):
        centroids, near = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                m = matrix_of(row["matrix"], row["rows"], dims, narrow)
                if near is None:
                    cluster, distance = nearest_of_all(m, centroids)
                    computed = len(m) * k
                else:
                    cluster, distance, computed = nearest_in_balls(m, centroids, np.array(row["clusters"], np.int64), near)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]]), pa.array([cluster.astype(np.int32)], pa.list_(pa.int32())), pa.array([[min(int(d), MOST) for d in distance]], pa.list_(pa.int64())),
                        pa.array([sums_of(m, cluster, distance, k)], pa.list_(pa.string())), pa.array([computed], pa.int64()),
                    ], names=["block", "clusters", "distances", "sums", "computed"],
                )

    rows = blocks.select("block", "matrix", F.size("ids").alias("rows"))
    if state is not None:
        rows = rows.hint("merge").join(state.select("block", "clusters"), "block")
    return rows.mapInArrow(run, "block long, clusters array<int>, distances array<long>, sums array<string>, computed long")


def ball_k_means(embeddings: DataFrame, k: int, rounds: int, dims: int = 64, scale: float = 1024.0, seed: int = 3, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, computed of all vectors that take part.

    Vectors have exactly `dims` components, none null or non-finite; each becomes floor(scale * x). Centroids begin as the k
    vectors of least sha256('<seed>:<vec_id>'). Each round assigns every vector to its nearest centroid (ties: the smaller
    number) and then replaces each centroid by the floored mean of its vectors, if it has any; at last all are assigned
    once more. Results are those of comparing every vector with every centroid, in whole numbers of any size; distances
    and inertias beyond 64 bits count as the largest number.

    Vectors lie in written blocks that no round shuffles or writes again. A round reads them beside the last assignments,
    joined by buckets, and writes assignments, distances and sums of each block. A cluster's ball has the centroid's shift
    added to its radius. computed is how many distances all rounds computed together, of count * k * (rounds + 1).

    Rows that repeat a vec_id, or have none, are vectors of their own; those without a vec_id are no first centroid, and if
    fewer than k vectors have one, there are so many clusters. A table where no vector takes part gives an empty one. Other
    columns are not read.
    """
    spark = embeddings.sparkSession
    vectors = fit_vectors(embeddings, dims, vector)
    centroids = first_centroids(vectors, k, scale, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, computed long"
    if not centroids:
        return spark.createDataFrame([], schema)
    bytes_ = vectors.count() * dims * 4
    buckets = min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BUCKET_BYTES)))
    blocks, *made = write_blocks(vectors, scale, dims, buckets)
    state, near, computed, old = None, None, 0, None
    for turn in range(rounds + 1):
        state, *place = save(assign(blocks, state, centroids, near), "assignments", buckets)
        if old:
            spark.sql(f"DROP TABLE {old[0]}")
            shared.remove(spark, old[1])
        old = place
        found = totals(state, len(centroids))
        computed += state.agg(F.sum("computed")).first()[0]
        if turn < rounds:
            before = centroids
            centroids = [[s // found[j][0] for s in found[j][3]] if j in found else c for j, c in enumerate(centroids)]
            reach = []
            for j, (a, b) in enumerate(zip(before, centroids)):
                r, s = found[j][2] if j in found else 0, sum((x - y) ** 2 for x, y in zip(a, b))
                reach.append(r + s + 2 * (math.isqrt(r * s) + 1))
            near = neighbours(centroids, reach)
    inertia = sum(f[1] for f in found.values())
    rows = [(j, min(f[1], MOST), min(inertia, MOST), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, f in found.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    listed = blocks.select("block", "ids").hint("merge").join(state.select("block", "clusters", "distances"), "block")
    each = listed.select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("x")).select(F.col("x.ids").alias("vec_id"), F.col("x.clusters").alias("cluster"), F.col("x.distances").alias("distance"))
    return each.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.lit(computed).cast("long").alias("computed"))  # k rows


def op13_ball_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_k_means(shared.table(spark, sf_dir, "embeddings"), k=8, rounds=10).drop("computed")


def lloyd_sql(k: int, rounds: int, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB SQL that compares every vector with every centroid in every round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS p FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT r, vec_id, v, min(d).a AS d, min(d).b AS c FROM (
  SELECT r, vec_id, v, {{'a': CAST(list_inner_product(v, v) - 2 * list_inner_product(v, p) + list_inner_product(p, p) AS BIGINT), 'b': c}} AS d FROM v, c{t}) GROUP BY r, vec_id, v)""".replace("min(d).a", "struct_extract(min(d), 'a')").replace("min(d).b", "struct_extract(min(d), 'b')"))
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m, p) AS p FROM c{t} LEFT JOIN (
  SELECT c, list(floor(s / n) ORDER BY i) AS m FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY c, i) GROUP BY c) USING (c))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)},
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS one FROM {last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, one AS cluster_inertia, CAST((SELECT sum(one) FROM i) AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in p], ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} USING (c) JOIN i USING (c)"""


OP13_SQL = lloyd_sql(8, 10)
