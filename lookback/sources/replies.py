"""Replies of web services as rows: title, url, text, published and what else a service tells. One column holds a reply each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import iso_date, one_line
from .text import abstract

WORK = "struct<id:string,doi:string,title:string,publication_date:string,abstract_inverted_index:map<string,array<int>>,primary_topic:struct<display_name:string>>"


#: What a parser gives of an item, beside its reply's own columns (request, day and the like).
ITEM = ("place", "title", "url", "text", "published")


def _items(replies: DataFrame, body: str, schema: str, path: str) -> DataFrame:
    """A reply's own columns, place (from 0 in each reply) and i, the items of a list in it; replies that don't parse have none.

    Own columns that have a name of ITEM are left out.
    """
    listed = F.from_json(F.col(body), schema)
    own = [c for c in replies.columns if c != body and c not in (*ITEM, "i")]
    return replies.select(*own, F.posexplode(listed if not path else listed.getField(path)).alias("place", "i"))


def _item(rows: DataFrame, title: Column, url: Column, text: Column, published: Column) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c not in ("place", "i")], "place", title.alias("title"), url.alias("url"), text.alias("text"), published.alias("published"))


def _blank(c: Column) -> Column:
    return F.coalesce(one_line(c), F.lit(""))


def paper_url(doi: Column) -> Column:
    """The abs page of a DOI under which an arXiv paper is registered; the DOI itself otherwise."""
    found = F.regexp_extract(doi, r"(?i)10\.48550/arxiv\.(.+)$", 1)
    return F.when(found != "", F.concat(F.lit("https://arxiv.org/abs/"), found)).otherwise(doi)


def works(replies: DataFrame, body: str) -> DataFrame:
    """Works of a bibliographic service: the abstract from its inverted index, the topic as its last line."""
    rows = _items(replies, body, f"struct<results:array<{WORK}>>", "results")
    text, topic = F.coalesce(abstract(F.col("i.abstract_inverted_index")), F.lit("")), F.col("i.primary_topic.display_name")
    marked = F.when(topic.isNull(), text).otherwise(F.concat_ws("\n", F.nullif(text, F.lit("")), F.concat(F.lit("Topic: "), topic)))
    return _item(rows, _blank(F.col("i.title")), paper_url(F.coalesce("i.doi", "i.id")), marked, iso_date(F.col("i.publication_date")))


def topic_of(text: Column) -> Column:
    """The topic that works() wrote into a text."""
    return F.nullif(F.regexp_extract(text, r"(?:^|\n)Topic: ([^\n]+)\s*$", 1), F.lit(""))


def daily_papers(replies: DataFrame, body: str) -> DataFrame:
    rows = _items(replies, body, "array<struct<paper:struct<id:string,title:string,summary:string,publishedAt:string>>>", "")
    return _item(rows, _blank(F.col("i.paper.title")), F.concat(F.lit("https://arxiv.org/abs/"), F.col("i.paper.id")), _blank(F.col("i.paper.summary")), iso_date(F.col("i.paper.publishedAt")))


def searched_papers(replies: DataFrame, body: str) -> DataFrame:
    """Papers that a search of a hub's papers found; their address is the hub's own."""
    rows = _items(replies, body, "array<struct<paper:struct<id:string,title:string,summary:string,publishedAt:string>>>", "")
    return _item(rows, _blank(F.col("i.paper.title")), F.concat(F.lit("https://huggingface.co/papers/"), F.col("i.paper.id")), _blank(F.col("i.paper.summary")), iso_date(F.col("i.paper.publishedAt")))


def daily_date(now: Column) -> Column:
    """The UTC day before."""
    return F.date_sub(F.to_date(now), 1)


def repositories(replies: DataFrame, body: str) -> DataFrame:
    """Repositories with a description; their topics follow it."""
    rows = _items(replies, body, "struct<items:array<struct<full_name:string,html_url:string,description:string,topics:array<string>,pushed_at:string>>>", "items")
    about, topics = _blank(F.col("i.description")), F.array_join("i.topics", ", ")
    text = F.when(F.coalesce(F.size("i.topics"), F.lit(0)) > 0, F.concat(about, F.lit(" Topics: "), topics)).otherwise(about)
    return _item(rows.filter(about != ""), F.col("i.full_name"), F.col("i.html_url"), text, iso_date(F.col("i.pushed_at")))


def recommended(replies: DataFrame, body: str) -> DataFrame:
    """Recommended papers that have an abstract; arXiv ids give their address."""
    rows = _items(replies, body, "struct<recommendedPapers:array<struct<title:string,abstract:string,url:string,publicationDate:string,externalIds:struct<ArXiv:string,DOI:string>>>>", "recommendedPapers")
    ids = F.col("i.externalIds")
    url = F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), ids["ArXiv"]), F.concat(F.lit("https://doi.org/"), ids["DOI"]), F.col("i.url"))
    return _item(rows.filter(_blank(F.col("i.abstract")) != ""), _blank(F.col("i.title")), url, _blank(F.col("i.abstract")), iso_date(F.col("i.publicationDate")))


def seed_token(positive: Column, negative: Column, most: int = 100) -> Column:
    """pos,...|neg,... of at most `most` ids a side."""
    side = lambda c: F.array_join(F.slice(c, 1, most), ",")
    return F.concat(side(positive), F.lit("|"), side(negative))


def seeds_of(token: Column) -> Column:
    """struct(positive, negative) of a token."""
    side = lambda k: F.filter(F.split(F.split_part(token, F.lit("|"), F.lit(k)), ","), lambda x: x != "")
    return F.struct(side(1).alias("positive"), side(2).alias("negative"))


def published_on(value: Column) -> Column:
    """An ISO date or that of a mail header."""
    mail = F.try_to_date(F.regexp_extract(value, r"(\d{1,2} \w{3} \d{4})", 1), "d MMM yyyy")
    return F.coalesce(iso_date(value), mail)


def web_results(replies: DataFrame, body: str) -> DataFrame:
    rows = _items(replies, body, "struct<results:array<struct<title:string,url:string,content:string,published_date:string>>>", "results")
    return _item(rows, _blank(F.col("i.title")), F.col("i.url"), _blank(F.col("i.content")), published_on(F.col("i.published_date")))


def sitemap_pages(replies: DataFrame, body: str, prefix: str, today: Column, days: int = 3) -> DataFrame:
    """url, published of pages below a prefix changed within days, the newest first, then as in the file."""
    entry = F.from_xml(F.col(body), "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>").getField("url")
    rows = replies.select(F.posexplode(entry).alias("place", "i")).select("place", F.trim("i.loc").alias("url"), F.trim("i.lastmod").alias("lastmod"))
    dated = rows.withColumn("published", iso_date(F.col("lastmod"))).filter(F.startswith("url", F.lit(prefix)) & (F.length("url") > len(prefix)))
    within = dated.filter((F.col("published") >= F.date_sub(today, days)) & (F.col("published") <= today))
    return within.orderBy(F.desc("published"), F.desc("lastmod"), "place").select("url", "published")


def announced(items: DataFrame, kind: str = "announce_type", text: str = "text") -> DataFrame:
    """New and cross-listed items of a listing, without the prefix before the abstract."""
    return items.filter(F.col(kind).isin("new", "cross")).withColumn(text, one_line(F.regexp_replace(F.col(text), r"(?s)^.*?Abstract:\s*", "")))


def adapter_of(url: Column) -> Column:
    """Which reader an address takes."""
    return (
        F.when(F.rlike(url, F.lit(r"^https?://arxiv\.org/(abs|pdf)/")), "arxiv")
        .when(F.rlike(url, F.lit(r"^https?://github\.com/[^/]+/[^/]+/?$")), "github")
        .when(F.rlike(url, F.lit(r"^https?://(dx\.)?doi\.org/")), "doi")
        .when(F.rlike(url, F.lit(r"^https?://")), "page")
    )


def vocabulary(replies: DataFrame, body: str) -> DataFrame:
    """term, place: names and alternate names of the concepts of a foreign graph document, each once, in order."""
    node = "struct<`@type`:string,name:string,alternateName:string>"
    rows = replies.select(F.posexplode(F.from_json(F.col(body), f"struct<`@graph`:array<{node}>>").getField("@graph")).alias("p", "i"))
    kind = F.element_at(F.split(F.regexp_replace("i.`@type`", r'[\[\]"]', ""), r"[/#:,]"), -1)
    # an alternate name is a text, a list of texts or an object with one
    other = F.col("i.alternateName")
    listed = F.coalesce(F.from_json(other, "array<string>"), F.array(F.coalesce(F.get_json_object(other, "$['@value']"), other)))
    each = rows.filter(kind.isin("Concept", "DefinedTerm")).select("p", F.posexplode(F.concat(F.array("i.name"), F.coalesce(listed, F.array().cast("array<string>")))).alias("q", "term"))
    named = each.filter(_blank(F.col("term")) != "").groupBy("term").agg(F.min(F.struct("p", "q")).alias("_o"))
    return named.withColumn("place", F.row_number().over(Window.orderBy("_o")) - 1).select("term", "place")  # one row a term


def opened_notes(replies: DataFrame, body: str, pattern: str) -> DataFrame:
    """note: names of recently opened files that match a pattern, each once."""
    files = F.from_json(F.col(body), "struct<lastOpenFiles:array<string>>").getField("lastOpenFiles")
    rows = replies.select(F.explode(files).alias("file")).filter(F.rlike("file", F.lit(pattern)))
    return rows.select(F.regexp_replace(F.substring_index("file", "/", -1), r"\.md$", "").alias("note")).distinct()


def marks(notes: DataFrame, text: str = "text") -> DataFrame:
    """kind, payload, ticked of every box of a note that a machine wrote: `- [x] ... <!-- app:kind payload -->`."""
    line = F.explode(F.split(F.col(text), "\n"))
    rows = notes.withColumn("_line", line)
    pattern = r"^\s*-\s*\[([ xX])\].*<!--\s*\w+:(\S+)\s+(\S+)\s*-->\s*$"
    part = lambda k: F.regexp_extract("_line", pattern, k)
    return rows.filter(F.rlike("_line", F.lit(pattern))).select(*[c for c in notes.columns if c != text], part(2).alias("kind"), part(3).alias("payload"), (F.lower(part(1)) == "x").alias("ticked"))


def followed(items: DataFrame, pages: DataFrame, most: int, request: list[str] | None = None) -> DataFrame:
    """items with the text of their page where they have none, for the first `most` of each request by place; skipped says
    which of those without a text got none.

    request: columns that name a reply (all of one reply, where there are none). A page that is there twice counts once, by
    its greatest text.
    """
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    numbered = items.withColumn("_n", F.row_number().over(Window.partitionBy(*turn_of(request or []), blank).orderBy("place")))
    text = pages.groupBy("url").agg(F.max("text").alias("_page"))
    out = numbered.join(text, "url", "left").withColumn("_page", F.when(blank & (F.col("_n") <= most), F.col("_page")))
    filled = F.coalesce(F.nullif(F.trim("text"), F.lit("")), "_page", F.lit(""))
    return out.select(*[filled.alias("text") if c == "text" else F.col(c) for c in items.columns], (blank & F.col("_page").isNull()).alias("skipped"))


def turn_of(request: list[str]) -> list[Column]:
    """What a reply's items are numbered within."""
    return [F.col(c) for c in request] or [F.lit(1)]


def first_nets(fetched: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """fetched with the net that discovered an item first: the stored one where there is one (the least, if there are several)."""
    known = stored.groupBy(key).agg(F.min("net").alias("_net"))
    return fetched.join(known, key, "left").withColumn("net", F.coalesce("_net", "net")).drop("_net")


def new_stages(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests of a day that no completed stage has: one a (adapter, net, query, day)."""
    key = ["adapter", "net", "query", "day"]
    asked = requests.dropDuplicates(key)
    on = [asked[k].eqNullSafe(done[k]) for k in key]
    return asked.join(done.select(*key), on, "left_anti")


def draft_counts(drafts: DataFrame) -> DataFrame:
    """One row: drafts, invalid (no web address, title or text), repeated (valid, of an address that an earlier one has)."""
    good = F.coalesce(F.rlike("url", F.lit("^https?://")) & (F.length(F.trim("title")) > 0) & (F.length(F.trim("text")) > 0), F.lit(False))
    return drafts.agg(F.count("*").alias("drafts"), F.count_if(~good).alias("invalid"), (F.count_if(good) - F.count_distinct(F.when(good, F.col("url")))).alias("repeated"))
