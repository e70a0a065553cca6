"""What several operators need: tables, the shared folder, tables written there, running sums, files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that part words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t\n\x0B\f\r]+"

_own_dir: list[str] = []
_kept: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset (tests), one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set, and a folder of this machine is none that executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="lookback-"))
        spark.sparkContext.setCheckpointDir(_own_dir[0])
    return _own_dir[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lookback/{name}-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(forget)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing of it."""
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of a query that ends in here are deleted at its end; else they stay until the driver's JVM happens to
    collect its garbage. For queries whose results are written or collected once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; empty for null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def spread(df: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """The rows, range-partitioned by order and written down, with their range number in _part."""
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    return materialize(ranged, name)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, to what spread() gave, the sums over all rows before each row in the given order.

    No task holds more than one range: totals of ranges (as many rows as ranges) are summed up first and handed to
    the rows of each range.
    """
    totals = df.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(F.broadcast(totals), "_part")  # one row a range
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"_before_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_part", *[f"_before_{k}" for k in sums])


def open_store(path: str):
    """pyarrow's file system and the path in it, for files that tasks write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def kept(name: str, make):
    """What a worker process keeps from task to task under a name. Only speed depends on it.

    Worker processes live on from stage to stage, so what was kept under another name is dropped first: a process holds
    the table of one operator at a time.
    """
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def row_steps(batch, rows: int = 500, most: int = 8 << 20):
    """An Arrow batch in slices of at most so many rows and, but for a single longer row, so many bytes of text, so that a
    task holds few of its texts as Python strings at once."""
    import pyarrow.compute as pc
    from pyarrow import types

    texts = [c for c in batch.columns if types.is_string(c.type) or types.is_large_string(c.type)]
    sizes = [pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in texts]
    start = total = 0
    for i, size in enumerate(map(sum, zip(*sizes)) if sizes else [0] * len(batch)):
        if i > start and (i - start == rows or total + size > most):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(batch):
        yield batch.slice(start)


def slices(texts: list[str], chars: int):
    """Ranges (start, end) over a list of texts of about so many characters each; a long text has its own."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
