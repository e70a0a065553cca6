"""Exact sizes of unions of finds over many sets of requests, by bitmaps of numbered keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import folders


def numbered_keys(finds: DataFrame, key: list[str]) -> DataFrame:
    """Each different key with a number of its own; numbers are dense within a task, so that bitmaps are full."""
    return folders.written(finds.select(*key).distinct().withColumn("_n", F.monotonically_increasing_id()), "keys")


def bitmaps(finds: DataFrame, request: list[str], key: list[str]) -> DataFrame:
    """request, block, bits: a request's keys as one bitmap for each block of numbers that it has any of; written."""
    keys = numbered_keys(finds, key)
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    rows = finds.alias("f").join(keys.alias("k"), on).select(*[F.col(f"f.{r}").alias(r) for r in request], "_n")
    block, bit = F.bitmap_bucket_number("_n"), F.bitmap_bit_position("_n")
    return folders.written(rows.groupBy(*request, block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits")), "bitmaps")


def union_sizes(finds: DataFrame, request: list[str], key: list[str], sets: DataFrame, of: str, known: DataFrame | None = None) -> DataFrame:
    """of, requests, found: by set of requests, how many it sends and how many different keys they find together.

    sets has `of` and the columns of a request. Keys of `known` count for nothing. What is put together for a set is one
    bitmap a request and block, never its finds; a set of which no request finds anything has 0.
    """
    fresh = finds if known is None else finds.join(known.select(*key).distinct(), key, "left_anti")
    asked = sets.select(of, *request).distinct()
    joined = asked.join(bitmaps(fresh, request, key), request)
    sizes = joined.groupBy(of, "block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")).groupBy(of).agg(F.sum("n").alias("found"))
    counts = asked.groupBy(of).agg(F.count("*").alias("requests"))
    return counts.join(sizes, of, "left").select(of, "requests", F.coalesce("found", F.lit(0)).cast("long").alias("found"))
