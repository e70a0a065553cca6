"""Line-shaped sources: JSON lines, call ledgers, question files, feeds and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import main_text, one_line, page_title


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file, split at line feeds only; lines that don't parse are left out."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return lines.filter("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def first_seen(spark: SparkSession, path: str) -> DataFrame:
    """The earliest date of each note in {"note", "first_seen"} lines."""
    rows = json_lines(spark, path, "note string, first_seen string")
    day = F.try_to_date(F.col("first_seen"), "yyyy-MM-dd")
    return rows.filter(F.col("note").isNotNull() & day.isNotNull()).groupBy("note").agg(F.min(day).alias("first_seen"))


def ledger_calls(rows: DataFrame, order: str = "n") -> DataFrame:
    """The latest row of each call_id; rows without one are calls of their own."""
    own = F.coalesce("call_id", F.concat(F.lit("row "), F.col(order).cast("string")))
    columns = rows.columns
    best = rows.groupBy(own.alias("_call")).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return best.select("_row.*")


def question_fields(lines: DataFrame, path: str = "path", n: str = "n", line: str = "line") -> DataFrame:
    """path, block, title, key, value, place of `- key: value` lines under `## title` headings; text before a heading is left out.

    Blocks are numbered within a file, which is one task's work; files are dealt over tasks.
    """
    upto = Window.partitionBy(path).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.startswith(F.col(line), F.lit("## "))
    numbered = lines.withColumn("block", F.sum(heading.cast("int")).over(upto)).filter("block > 0")
    titled = numbered.withColumn("title", F.last(F.when(heading, F.trim(F.substring(line, 4, 1 << 20))), ignorenulls=True).over(upto))
    field = r"^\s*-\s*([A-Za-z_]+):\s*(.*?)\s*$"
    return titled.filter(F.rlike(F.col(line), F.lit(field))).select(path, "block", "title", F.lower(F.regexp_extract(line, field, 1)).alias("key"), F.regexp_extract(line, field, 2).alias("value"), F.col(n).alias("place"))


def pages(html: DataFrame, url: str = "url", body: str = "html", chars: int = 4000) -> DataFrame:
    """url, title and text of web pages."""
    return html.select(url, page_title(F.col(body)).alias("title"), main_text(F.col(body), chars).alias("text"))


def abstract(inverted: Column) -> Column:
    """Text from a map of words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def feed_items(xml: DataFrame, body: str, today: Column, days: int = 3) -> DataFrame:
    """title, link, text, published of RSS items dated within days; undated and empty ones are left out."""
    item = F.explode(F.from_xml(F.col(body), "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING>>>").getField("channel").getField("item"))
    rows = xml.select(item.alias("i")).select("i.*")
    day = F.coalesce(F.try_to_date(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4})", 1), "d MMM yyyy"), F.try_to_date(F.substring("pubDate", 1, 10), "yyyy-MM-dd"))
    dated = rows.select(one_line(F.col("title")).alias("title"), "link", one_line(F.col("description")).alias("text"), day.alias("published"))
    return dated.filter((F.col("published") >= F.date_sub(today, days)) & (F.col("published") <= today) & (F.col("text") != ""))


def valid_drafts(drafts: DataFrame, place: str = "place") -> DataFrame:
    """One draft of each url, the first; drafts without a web address, title or text are left out."""
    good = drafts.filter(F.rlike("url", F.lit("^https?://")) & (F.length(F.trim("title")) > 0) & (F.length(F.trim("text")) > 0))
    columns = good.columns
    return good.groupBy("url").agg(F.min_by(F.struct(*columns), place).alias("_row")).select("_row.*")
