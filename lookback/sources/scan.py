"""Keys in a tree of documents, scanned again and again: where each was first seen, and what couldn't be read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from . import documents, folders, keyed

#: Longest file that is read. Places by precedence, and how a machine's own notes are known.
LONGEST, PLACES = 2_000_000, ("graph", "adr", "vault")


@dataclass
class Scan:
    """found: key, place, path (the first place that holds it). unread: path. tainted: key, of files that the scan before couldn't read."""

    found: DataFrame
    unread: DataFrame
    tainted: DataFrame


def read_tree(spark: SparkSession, root: str, pattern: str, longest: int = LONGEST) -> DataFrame:
    """path (below root), length and text of the files of a tree; texts of longer ones are null, and are never opened.

    Hidden files and folders, whose names begin with a dot, are left out. Bytes that are no UTF-8 are replaced.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = folders.file_system(spark, root)[0].toUri().getPath().rstrip("/")
    path = F.regexp_replace("path", rf"^[a-z]+:/*\Q{base}\E/", "")
    listed = files.select(path.alias("path"), "length").filter(~F.rlike("path", F.lit(r"(^|/)\.")))
    texts = files.filter(F.col("length") <= longest).select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return listed.join(texts, "path", "left")


def within_budget(files: DataFrame, most: int) -> DataFrame:
    """files with a null text beyond the first `most` bytes by path: ranges of paths are summed first, so no task sorts them all."""
    from pyspark.sql import Window

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = folders.written(files.repartitionByRange(parts, "path").withColumn("_part", F.spark_partition_id()), "files")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum("length").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))  # a row a range
    own = F.sum("length").over(Window.partitionBy("_part").orderBy("path"))
    return ranged.withColumn("_own", own).join(F.broadcast(sums), "_part").withColumn("text", F.when(F.col("_before") + F.col("_own") <= most, F.col("text"))).drop("_part", "_own", "_before")


def place_of(path: Column, kind: Column) -> Column:
    """graph, adr, or vault and the top folder of a note."""
    return F.when(kind != "vault", kind).when(F.contains(path, F.lit("/")), F.concat(F.lit("vault:"), F.substring_index(path, "/", 1))).otherwise("vault")


def graph_texts(files: DataFrame) -> DataFrame:
    """path, text of files whose text is JSON: its strings, a line each; of others the text itself."""
    strings = documents.json_strings(files.select(F.col("path").alias("_file"), "text"), "_file", "text")
    strings = strings.groupBy(F.col("_file").alias("path")).agg(F.array_join(F.collect_list("text"), "\n").alias("_strings"))
    broken = F.try_parse_json("text").isNull()
    return files.select("path", "text").join(strings, "path", "left").select("path", F.when(broken, F.col("text")).otherwise(F.coalesce("_strings", F.lit(""))).alias("text"))


def scan(files: DataFrame, prior_unread: DataFrame | None = None, owner: str | None = None, own_mark: str | None = None) -> Scan:
    """The keys of all files that could be read.

    files: path, kind (one of PLACES), text (null: not read). A key is at the first place by precedence and path. own_mark:
    what the notes that a machine writes have in their texts; those aren't documents of the author. Keys of the author's own
    repositories (owner) don't count. A key that is found in a file which the scan before couldn't read is tainted: when it
    was there first isn't known.
    """
    read = files.filter(F.col("text").isNotNull())
    graphs = read.filter("kind = 'graph'")
    body = read.filter("kind <> 'graph'").select("path", "kind", "text").unionByName(graph_texts(graphs).withColumn("kind", F.lit("graph")))
    if own_mark is not None:
        body = body.filter(~((F.col("kind") == "vault") & F.contains("text", F.lit(own_mark))))
    each = body.select("path", "kind", F.explode(F.array_distinct(keys.keys_of_text(F.col("text")))).alias("key"))
    if owner is not None:
        each = each.filter(~F.startswith("key", F.lit(f"gh:{owner.lower()}/")) & ~F.startswith("key", F.lit(f"url:github.com/{owner.lower()}/")))
    each = folders.written(each, "document-keys")
    rank = F.array_position(F.array(*map(F.lit, PLACES)), F.col("kind"))
    found = each.groupBy("key").agg(F.min_by(F.struct(place_of(F.col("path"), F.col("kind")).alias("place"), "path"), F.struct(rank, "path")).alias("r")).select("key", "r.place", "r.path")
    tainted = each.limit(0).select("key") if prior_unread is None else each.join(prior_unread.select("path"), "path", "left_semi").select("key").distinct()
    return Scan(found, files.filter(F.col("text").isNull()).select("path").distinct(), tainted)


def record(spark: SparkSession, path: str, made: Scan, day: Column, buckets: int = 16) -> None:
    """Adds what a scan saw for the first time to the table of sightings (keyed by key), and puts its unread files in place of
    those of the scan before.

    key, place, path, first_seen, baseline (seen by the first scan), unsure (tainted). A row that is there stays.
    """
    baseline = F.lit(keyed.read(spark, f"{path}/sightings") is None)
    rows = made.found.join(made.tainted.withColumn("_t", F.lit(True)), "key", "left")
    seen = rows.select("key", "place", "path", day.alias("first_seen"), baseline.alias("baseline"), F.coalesce("_t", F.lit(False)).alias("unsure"))
    keyed.add_first(spark, f"{path}/sightings", seen, ["key"], "first_seen", buckets)
    number = max([int(n) for n in folders.names_in(spark, f"{path}/unread")], default=0) + 1
    made.unread.coalesce(1).write.parquet(f"{path}/unread/{number:08d}")


def unread_before(spark: SparkSession, path: str) -> DataFrame | None:
    """path of the files that the latest recorded scan couldn't read; None before the first one."""
    known = [n for n in folders.names_in(spark, f"{path}/unread") if folders.has(spark, f"{path}/unread/{n}/_SUCCESS")]
    return spark.read.parquet(f"{path}/unread/{known[-1]}") if known else None
