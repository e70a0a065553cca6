"""What stands in JSON documents of no fixed schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folders


def json_strings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, text: every string value of every document, at any depth.

    path is $ with .name and [place] for each step down; a name with other characters than letters, digits and _ is quoted.
    Texts that are no JSON, and nulls, have none. Names themselves aren't values. The documents go down a level at a time, as
    deep as the deepest (key mustn't be named path, v, kind or text); a level is written before the next is read, and only objects and lists go on to it.
    """
    spark = docs.sparkSession
    level = docs.select(key, F.lit("$").alias("path"), F.try_parse_json(body).alias("v")).filter("v IS NOT NULL")
    found = []
    while True:
        kind = F.schema_of_variant("v")
        level = folders.written(level.select(key, "path", "v", F.when(kind == "STRING", "text").when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), "inner").alias("kind")).filter("kind IS NOT NULL"), "json")
        found.append(level.filter("kind = 'text'").select(key, "path", F.variant_get("v", "$", "string").alias("text")))
        inner = level.filter("kind = 'inner'")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_place", "_name", "_v"))
        name = F.when(F.rlike("_name", F.lit("^[A-Za-z0-9_]+$")), F.concat(F.lit("."), "_name")).otherwise(F.concat(F.lit('."'), "_name", F.lit('"')))
        step = F.when(F.col("_name").isNotNull(), name).otherwise(F.concat(F.lit("["), F.col("_place").cast("string"), F.lit("]")))
        level = below.select(key, F.concat("path", step).alias("path"), F.col("_v").alias("v"))
