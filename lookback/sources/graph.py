"""Node tables: partitions of graph documents, and tables with one row an id, the latest of which wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.windows import latest
from . import folders


class SchemaError(ValueError):
    pass


def read_partition(spark: SparkSession, path: str | list[str], node: StructType, context: str) -> DataFrame:
    """The nodes of JSON documents {"@context", "@graph": [...]} with their file in _file; another context or an id twice is an error."""
    schema = StructType().add("@context", "string").add("@graph", ArrayType(node))
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    if docs.filter(F.col("`@context`").isNull() | (F.col("`@context`") != context)).limit(1).count():
        raise SchemaError(f"a document of another context than {context}")
    nodes = docs.select("_file", F.inline("@graph"))
    if nodes.groupBy("_file", "id").count().filter("count > 1").limit(1).count():
        raise SchemaError("an id occurs twice in a document")
    return nodes


def read_lifted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table under today's schema: columns that it lacks are null; a column of another type is an error."""
    stored = spark.read.parquet(path)
    verdict, detail = schema_verdict(stored.schema, schema)
    if verdict == "incompatible":
        raise SchemaError(detail)
    return stored.select(*[F.col(f.name) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def schema_verdict(stored: StructType, today: StructType) -> tuple[str, str]:
    """current, additive or incompatible, with what differs. Only nullable columns can be added."""
    have, want = {f.name: f for f in stored}, {f.name: f for f in today}
    wrong = [n for n in have if n not in want or have[n].dataType.simpleString() != want[n].dataType.simpleString()]
    missing = [n for n in want if n not in have]
    if wrong or any(not want[n].nullable for n in missing):
        return "incompatible", ", ".join(wrong or missing)
    return ("additive", ", ".join(missing)) if missing else ("current", "")


def upserted(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with new rows in place of those with their key; of new rows with one key the last in order of `_n` wins.

    Both have the same columns; new has `_n` too.
    """
    fresh = latest(new, key, F.col("_n")).drop("_n")
    return stored.join(fresh.select(*key), key, "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that were written to their end, ascending."""
    hadoop, store = _store(spark, path)
    if not store.exists(hadoop(path)):
        return []
    names = [f.getPath().getName() for f in store.listStatus(hadoop(path)) if f.isDirectory()]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and store.exists(hadoop(f"{path}/{n}/_SUCCESS")))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of a table; None where there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def by_id(table: DataFrame, *ids: str) -> DataFrame:
    """The rows of some ids; the filter reaches the scan."""
    return table.filter(F.col("id").isin(*ids))


def read_snapshot(spark: SparkSession, paths: dict[str, str], node: StructType, context: str) -> DataFrame:
    """The nodes of several lines' documents in one read, with line."""
    names = spark.createDataFrame(list(paths.items()), "line string, _path string")
    nodes = read_partition(spark, list(paths.values()), node, context)
    return nodes.join(F.broadcast(names), F.endswith(F.col("_file"), F.regexp_replace("_path", "^file:/+", "/"))).drop("_file", "_path")


def replace_all(spark: SparkSession, path: str, rows: DataFrame, key: list[str], keep: int = 2) -> int:
    """Writes a table's next version and gives its number; the last `keep` stay.

    A version counts once it is written to its end, so whatever is lost in between leaves the one before. Which file is
    the latest follows from the folder's names alone. The second of two writers of one number fails.
    """
    found = versions(spark, path)
    hadoop, store = _store(spark, path)
    begun = [int(n[1:]) for n in folders.names_in(spark, path) if n[:1] == "v" and n[1:].isdigit()]
    following = max(begun, default=0) + 1
    rows.sortWithinPartitions(*key).write.mode("errorifexists").parquet(f"{path}/v{following}")
    for old in found[: len(found) + 1 - keep]:
        store.delete(hadoop(f"{path}/v{old}"), True)
    return following


def write_upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str]) -> None:
    """Upserts into a table of versions (see replace_all); new has the order of its rows in _n."""
    columns = [c for c in new.columns if c != "_n"]
    stored = read_table(spark, path)
    replace_all(spark, path, upserted(new.select(*columns).limit(0) if stored is None else stored, new, key), key)


def append_rows(path: str, rows: DataFrame) -> None:
    """Appends rows as JSON lines in files of their own: no writer closes another's last line."""
    rows.write.mode("append").json(path)


def append_new(spark: SparkSession, path: str, rows: DataFrame, key: list[str]) -> None:
    """Appends the rows whose key isn't there yet, one a key (the least row)."""
    hadoop, store = _store(spark, path)
    columns = [c for c in rows.columns if c not in key]
    once = rows.groupBy(*key).agg(F.min(F.struct(*columns)).alias("_r")).select(*key, "_r.*").select(*rows.columns) if columns else rows.distinct()
    if store.exists(hadoop(path)):
        once = once.join(spark.read.schema(rows.schema).json(path), key, "left_anti")
    append_rows(path, once)


def migrate(spark: SparkSession, path: str, schema: StructType, dry: bool = False) -> str:
    """current, additive (the next version has the missing columns, null) or incompatible (the table is set aside); dry only says which."""
    stored = read_table(spark, path)
    if stored is None:
        return "current"
    verdict, _ = schema_verdict(stored.schema, schema)
    if verdict == "additive" and not dry:
        lifted = stored.select(*[F.col(f.name) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        replace_all(spark, path, lifted, [schema[0].name])
    if verdict == "incompatible" and not dry:
        hadoop, store = _store(spark, path)
        store.rename(hadoop(path), hadoop(f"{path}.retired-{versions(spark, path)[-1]}"))
    return verdict


def violations(nodes: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """id and rule of every node that breaks a rule; a rule that is null for a node is broken."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return nodes.select("id", F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


# Rules of node types: what a valid node holds.
NODE_RULES: dict[str, Callable[[], dict[str, Column]]] = {
    "unit": lambda: {"span": (F.col("start") >= 0) & (F.col("end") > F.col("start")), "text": F.length("text") == F.col("end") - F.col("start")},
    "label": lambda: {"verdict": F.col("verdict").isin("correct", "wrong"), "harvest": F.col("first_harvested_at").isNull() | (F.col("first_harvested_at") <= F.col("harvested_at"))},
    "used_mark": lambda: {"seen": (F.col("verdict") == "used") == F.col("seen_on").isNotNull(), "window": F.col("seen_on").isNull() | (F.col("seen_on") > F.col("surfaced_on"))},
    "sighting": lambda: {"key": F.length("key") > 0, "first_seen": F.col("first_seen").isNotNull()},
}


def fresh_requests(asked: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """What must still be asked: one row a key that no stored answer has."""
    return asked.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def without(stored: DataFrame, ids: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """stored without the given ids, and how many of its rows that removes."""
    gone = stored.join(ids.select(*key).distinct(), key, "left_semi").count()
    return stored.join(ids.select(*key), key, "left_anti"), gone


def stage_hits(stages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stages with all their outputs still there: id and outputs of each."""
    each = stages.select(F.col("id").alias("stage"), F.explode_outer("outputs").alias("id"))
    dangling = each.filter("id IS NOT NULL").join(nodes.select("id"), "id", "left_anti").select("stage").distinct()
    return stages.join(dangling, F.col("id") == F.col("stage"), "left_anti")
