"""Tables by key in buckets: a batch writes only the buckets that its keys are in, and a manifest names each bucket's files.

A row with a null in its key is like no other row, and is added each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders

#: Buckets of a table; it keeps the number that it was made with.
BUCKETS = 64
#: Manifests that stay, with the files that they name.
KEEP = 2


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that were written to their end."""
    return [int(n) for n in folders.names_in(spark, f"{path}/manifest") if folders.has(spark, f"{path}/manifest/{n}/_SUCCESS")]


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict[int, int]:
    """By bucket the number of the batch that wrote it last; as many rows as there are buckets come to the driver."""
    known = manifests(spark, path)
    if not known:
        return {}
    rows = spark.read.parquet(f"{path}/manifest/{number or known[-1]:08d}").collect()
    return {r["bucket"]: r["batch"] for r in rows}


def _read(spark: SparkSession, path: str, written: dict[int, int]) -> DataFrame | None:
    if not written:
        return None
    return spark.read.parquet(*[f"{path}/data/{batch:08d}/bucket={bucket}" for bucket, batch in sorted(written.items())])


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as its latest manifest has it; None where there is none."""
    return _read(spark, path, manifest(spark, path))


def change(spark: SparkSession, path: str, batch: DataFrame, key: list[str], put: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Writes put(stored, batch) of the buckets that the batch's keys are in, and gives these buckets.

    stored has the rows of those buckets alone, or is None where there are none. A change counts once its manifest is written
    to its end; one that is lost before leaves the table as it was. The second of two writers of one number fails, instead
    of writing over the first. Files that none of the last KEEP manifests names are removed.
    """
    placed = batch.withColumn("bucket", bucket_of(key, buckets))
    touched = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())
    if not touched:
        return []
    written = manifest(spark, path)
    number = max([int(n) for n in (*folders.names_in(spark, f"{path}/data"), *folders.names_in(spark, f"{path}/manifest"))], default=0) + 1
    stored = _read(spark, path, {b: v for b, v in written.items() if b in set(touched)})
    after = put(stored, batch).withColumn("bucket", bucket_of(key, buckets))
    after.repartition("bucket").sortWithinPartitions("bucket", *key).write.partitionBy("bucket").mode("errorifexists").parquet(f"{path}/data/{number:08d}")
    # a bucket that lost all its rows has no files
    there = {int(n.partition("=")[2]) for n in folders.names_in(spark, f"{path}/data/{number:08d}") if n.startswith("bucket=")}
    now = {b: v for b, v in written.items() if b not in set(touched)} | {b: number for b in touched if b in there}
    spark.createDataFrame(sorted(now.items()), "bucket int, batch int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/{number:08d}")
    known = manifests(spark, path)
    named = {v for n in known[-KEEP:] for v in manifest(spark, path, n).values()}
    for n in known[:-KEEP]:
        folders.remove(spark, f"{path}/manifest/{n:08d}")
    for n in folders.names_in(spark, f"{path}/data"):
        if int(n) < number and int(n) not in named:
            folders.remove(spark, f"{path}/data/{n}")
    return touched


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: str, buckets: int = BUCKETS) -> list[int]:
    """Puts the last row of each key by `order` (a column of new that isn't stored; ties: the greatest row) in place of the stored one."""
    columns = [c for c in new.columns if c != order]

    def put(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        rest = [c for c in columns if c not in key]
        last = batch.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in columns])
        return last if stored is None else stored.select(*columns).join(last.select(*key), key, "left_anti").unionByName(last)

    return change(spark, path, new, key, put, buckets)


def add_first(spark: SparkSession, path: str, new: DataFrame, key: list[str], time: str, buckets: int = BUCKETS) -> list[int]:
    """Adds the first row of each key by time that the table doesn't have; what it has stays, however late."""

    def put(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c not in key]
        firsts = batch.groupBy(*key).agg(F.min(F.struct(time, *[c for c in rest if c != time])).alias("_r"))
        firsts = firsts.select(*[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in batch.columns])
        return firsts if stored is None else stored.select(*batch.columns).unionByName(firsts.join(stored.select(*key), key, "left_anti"))

    return change(spark, path, new, key, put, buckets)


def delete(spark: SparkSession, path: str, gone: DataFrame, key: list[str], buckets: int = BUCKETS) -> int:
    """Deletes the rows of some keys and gives how many there were."""
    stored = read(spark, path)
    if stored is None:
        return 0
    found = stored.select(*key).join(gone.select(*key).distinct(), key, "left_semi")
    n = found.count()
    if n:
        change(spark, path, found, key, lambda rows, batch: rows.join(batch, key, "left_anti"), buckets)
    return n
