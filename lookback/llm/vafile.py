"""Exact top-k by inner product with vector-approximation files (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Cells a dimension has (one byte each), and vectors in one block of candidates and of queries.
CELLS, CANDIDATES, QUERIES = 256, 8_192, 4_096
#: Exact vectors of a query that are read first, as a multiple of k.
FIRST = 4
#: Up to so large a bound of |score|, sums of products are exact in doubles.
EXACT = float(1 << 52)


def scaled(embeddings: DataFrame, vector: str, scale: float) -> DataFrame:
    """vec_id and v, floor(scale * x) for every component; vectors that are null or hold null or non-finite components go."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.filter(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"))


def cell_edges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of dimensions, each one's least value over all vectors and how many whole numbers a cell covers."""
    found = vectors.select("dims", F.posexplode("v").alias("d", "x")).groupBy("dims", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out = {}
    for dims in {r["dims"] for r in found}:
        own = sorted((r for r in found if r["dims"] == dims), key=lambda r: r["d"])
        low, high = np.array([r["low"] for r in own]), np.array([r["high"] for r in own])
        out[dims] = low, np.ceil((high - low + 1) / CELLS)
    return out


def write_file(vectors: DataFrame, edges: dict) -> DataFrame:
    """The approximation file, written: row (a number of its own), vec_id, dims, cells (a byte a dimension), v."""

    def run(batches):
        for batch in batches:
            dims, values = batch.column(2).to_pylist(), batch.column(3)
            cells = []
            for k, n in enumerate(dims):
                low, width = edges[n] if n else (np.zeros(0), np.ones(0))
                cells.append(np.clip(np.floor((values[k].values.to_numpy(zero_copy_only=False) - low) / width), 0, CELLS - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], names=["row", "vec_id", "dims", "v", "cells"])

    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dims", "v")
    return shared.materialize(numbered.mapInArrow(run, "row long, vec_id long, dims int, v array<double>, cells binary"), "cells")


def scan(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int):
    """(query place, vector place, lower bound, upper bound) of all that can be among a query's k best of a block.

    Only cells are read, once, in one product: the score with the middles of the cells. As components are whole numbers, it
    is off by at most half of |q|.(width - 1), whatever the vector. A vector goes on if its upper bound reaches the kth
    lower bound.
    """
    grid, middle = cells.astype(np.float32), low + (width - 1) / 2
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        step = q * width
        largest, offset = np.abs(step).sum(axis=1) * CELLS, np.abs(q) @ np.abs(middle)
        # sums of whole numbers below 2^24 lose nothing in single precision
        slack = np.abs(q) @ (width - 1) / 2 + np.where(largest < 1 << 24, 0.0, len(width) * 2.0**-22 * largest) + np.where(offset < EXACT, 0.0, 1e-12 * offset)
        centre = (step.astype(np.float32) @ grid.T).astype(np.float64) + (q @ middle)[:, None]
        own = ids[None, :] == query_ids[a : a + 256, None]
        lower, upper = centre - slack[:, None], centre + slack[:, None]
        lower[own] = -np.inf
        keep = min(k, len(ids))
        certain = np.partition(lower, len(ids) - keep, axis=1)[:, len(ids) - keep]
        i, j = np.nonzero((upper >= certain[:, None]) & ~own)
        yield a + i, j, lower[i, j], upper[i, j]


def candidates_of(file: DataFrame, asked: DataFrame, edges: dict, k: int, per_block: int, per_group: int) -> DataFrame:
    """query_id, row, lower, upper: every pair of a block of queries and a block of cells is one group."""
    blocks, groups = max(1, -(-file.count() // per_block)), max(1, -(-asked.count() // per_group))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, salt, n: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(n)).cast("int")
    right = file.select("dims", dealt("row", 1, blocks).alias("block"), "row", "vec_id", "cells").select("*", numbers(groups).alias("group"))
    left = asked.select("dims", dealt("vec_id", 2, groups).alias("group"), "vec_id", "v").select("*", numbers(blocks).alias("block"))

    def search(queried, block):
        out: list[list[np.ndarray]] = [[], [], [], []]
        dims = queried.column("dims")[0].as_py() if len(queried) else 0
        if dims and len(block):
            query_ids, rows, ids = queried.column("vec_id").to_numpy(), block.column("row").to_numpy(), block.column("vec_id").to_numpy()
            queries = queried.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(query_ids), dims)
            cells = np.frombuffer(b"".join(block.column("cells").to_pylist()), np.uint8).reshape(len(rows), dims)
            for i, j, lower, upper in scan(query_ids, queries, ids, cells, *edges[dims], k):
                for column, values in zip(out, (query_ids[i], rows[j], lower, upper)):
                    column.append(values)
        arrays = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({n: pa.array(a.astype(t)) for n, a, t in zip(("query_id", "row", "lower", "upper"), arrays, ("i8", "i8", "f8", "f8"))})

    keys = ["dims", "group", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, row long, lower double, upper double")


def exact_scores(pairs: DataFrame, file: DataFrame, asked: DataFrame, in_doubles: bool) -> DataFrame:
    """query_id, vec_id, score of pairs (query_id, row), from exact vectors."""
    read = pairs.join(file.select("row", "vec_id", "v"), "row").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    if in_doubles:
        score = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).cast("long")
        return read.select("query_id", "vec_id", score.alias("score"))
    most = (1 << 63) - 1

    def run(batches):
        for batch in batches:
            found = [sum(int(a) * int(b) for a, b in zip(q, v)) for q, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([max(-most, min(most, s)) for s in found], pa.int64())], names=["query_id", "vec_id", "score"])

    return read.select("query_id", "vec_id", "q", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(embeddings: DataFrame, is_query, k: int, scale: float = 64.0, vector: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller vec_id.

    1. The file: every vector's cells, a byte a dimension, are written down beside the vectors.
    2. The scan: blocks of queries against blocks of cells give bounds; what can't be among the k best of its block goes.
    3. Over all blocks, what can't reach the kth lower bound goes.
    4. Exact vectors are read in order of their upper bounds: FIRST * k of a query; then all whose bound reaches the kth
       score of these. The rest is certain not to be among the k best.

    A task holds two blocks and no more. Vectors of different length are never compared. Rows that repeat a vec_id are
    candidates of their own, but not of queries with that id; such a query is answered once, for the shortest and least of
    its vectors. Scores beyond 64 bits count as the largest number. An empty table, or one without queries, gives an empty
    one. Other columns are not read.
    """
    vectors = scaled(embeddings, vector, scale).withColumn("dims", F.size("v"))
    edges = cell_edges(vectors)
    file = write_file(vectors, edges)
    asked = file.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dims", "v")).alias("q")).select("vec_id", "q.dims", "q.v")
    largest = max((float(np.abs(np.r_[low, low + width * CELLS]).max()) ** 2 * n for n, (low, width) in edges.items()), default=0.0)
    found = shared.materialize(candidates_of(file, asked, edges, k, candidates, queries), "candidates")
    by_lower, by_upper = (Window.partitionBy("query_id").orderBy(F.desc(c), "row") for c in ("lower", "upper"))
    kth = found.withColumn("n", F.row_number().over(by_lower)).filter(F.col("n") <= k).groupBy("query_id").agg(F.min("lower").alias("least"), F.max("n").alias("n"))
    reach = F.when(F.col("n") == k, F.col("least")).otherwise(F.lit(float("-inf")))
    open_ = found.join(kth.select("query_id", reach.alias("reach")), "query_id").filter("upper >= reach").select("query_id", "row", "upper", F.row_number().over(by_upper).alias("place"))
    open_ = shared.materialize(open_, "open")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = shared.materialize(exact_scores(open_.filter(F.col("place") <= FIRST * k), file, asked, largest < EXACT), "scores")
    sure = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("score").alias("kth"))
    rest = open_.filter(F.col("place") > FIRST * k).join(sure, "query_id").filter(F.col("upper") >= F.col("kth"))
    every = first.unionByName(exact_scores(rest.select("query_id", "row"), file, asked, largest < EXACT))
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
