"""Replies of services, written by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lookback.sources import graph, replies

D = dt.date


def body(spark, value):
    return spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),), ("not json",)], "b string")


def test_json_replies(spark):
    work = {"id": "W1", "doi": "https://doi.org/10.48550/arXiv.2601.00001", "title": " A\n b ", "publication_date": "2026-01-02", "abstract_inverted_index": {"two": [1, 2], "one": [0]}, "primary_topic": {"display_name": "T"}}
    got = replies.works(body(spark, {"results": [work, {"id": "W2", "title": None}]}), "b").orderBy("place").collect()
    assert [tuple(r) for r in got] == [(0, "A b", "https://arxiv.org/abs/2601.00001", "one two two\nTopic: T", D(2026, 1, 2)), (1, "", "W2", "", None)]
    assert [r["t"] for r in replies.works(body(spark, {"results": [work]}), "b").select(replies.topic_of(F.col("text")).alias("t")).collect()] == ["T"]
    got = replies.daily_papers(body(spark, [{"paper": {"id": "2601.1", "title": "t", "summary": "s", "publishedAt": "2026-01-02T00:00:00Z"}}]), "b").first()
    assert got["url"] == "https://arxiv.org/abs/2601.1" and got["published"] == D(2026, 1, 2)
    got = replies.repositories(body(spark, {"items": [{"full_name": "a/b", "description": "d", "topics": ["x", "y"]}, {"full_name": "c/d", "description": " "}]}), "b").collect()
    assert [(r["title"], r["text"]) for r in got] == [("a/b", "d Topics: x, y")]
    got = replies.recommended(body(spark, {"recommendedPapers": [{"title": "t", "abstract": "a", "externalIds": {"DOI": "10.1/x"}}, {"title": "u", "abstract": None}]}), "b").collect()
    assert [r["url"] for r in got] == ["https://doi.org/10.1/x"]
    got = replies.web_results(body(spark, {"results": [{"title": "t", "url": "u", "content": "c", "published_date": "Fri, 02 Jan 2026 10:00:00 GMT"}, {"url": "v", "published_date": "2026-01-03"}]}), "b").orderBy("place").collect()
    assert [r["published"] for r in got] == [D(2026, 1, 2), D(2026, 1, 3)]


def test_tokens_sitemaps_and_notes(spark):
    token = spark.createDataFrame([(["a", "b", "c"], ["d"])], "p array<string>, n array<string>").select(replies.seed_token(F.col("p"), F.col("n"), 2).alias("t"))
    assert token.first()["t"] == "a,b|d" and token.select(replies.seeds_of(F.col("t")).alias("s")).first()["s"]["negative"] == ["d"]
    xml = "<urlset>" + "".join(f"<url><loc>{u}</loc><lastmod>{d}</lastmod></url>" for u, d in (("https://x/b/", "2026-01-03"), ("https://x/b/1", "2026-01-02"), ("https://x/b/2", "2026-01-03T05:00:00Z"), ("https://x/c", "2026-01-03"), ("https://x/b/3", "2025-01-03"))) + "</urlset>"
    got = replies.sitemap_pages(spark.createDataFrame([(xml,)], "b string"), "b", "https://x/b/", F.lit("2026-01-04").cast("date")).collect()
    assert [r["url"] for r in got] == ["https://x/b/2", "https://x/b/1"]
    graph_text = {"@graph": [{"@type": "https://schema.org/DefinedTerm", "name": "one", "alternateName": ["uno", "one"]}, {"@type": "Person", "name": "x"}, {"@type": "skos:Concept", "name": "two", "alternateName": {"@value": "duo"}}]}
    assert [r["term"] for r in replies.vocabulary(body(spark, graph_text), "b").orderBy("place").collect()] == ["one", "uno", "two", "duo"]
    assert [r["note"] for r in replies.opened_notes(body(spark, {"lastOpenFiles": ["reader/2026-01-02.md", "other.md"]}), "b", r"^reader/").collect()] == ["2026-01-02"]
    note = spark.createDataFrame([("n", "- [x] yes <!-- app:claim c1 -->\n- [ ] no <!-- app:source s1 -->\ntext")], "note string, text string")
    assert [(r["kind"], r["payload"], r["ticked"]) for r in replies.marks(note).collect()] == [("claim", "c1", True), ("source", "s1", False)]
    kinds = spark.createDataFrame([("https://arxiv.org/abs/1",), ("https://github.com/a/b",), ("https://doi.org/1",), ("http://x",), ("ftp://x",)], "u string").select(replies.adapter_of(F.col("u")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["arxiv", "github", "doi", "page", None]


def test_items_and_stages(spark):
    items = spark.createDataFrame([(0, "u", " "), (1, "v", ""), (2, "w", "has")], "place int, url string, text string")
    pages = spark.createDataFrame([("u", "page"), ("v", "late")], "url string, text string")
    assert {(r["url"], r["text"], r["skipped"]) for r in replies.followed(items, pages, 1).collect()} == {("u", "page", False), ("v", "", True), ("w", "has", False)}
    nets = replies.first_nets(spark.createDataFrame([("1", "b"), ("2", "b")], "id string, net string"), spark.createDataFrame([("1", "a")], "id string, net string"))
    assert {(r["id"], r["net"]) for r in nets.collect()} == {("1", "a"), ("2", "b")}
    schema = "adapter string, net string, query string, day string"
    asked = spark.createDataFrame([("a", "n", None, "d"), ("a", "n", None, "d"), ("a", "n", "q", "d")], schema)
    assert [r["query"] for r in replies.new_stages(asked, spark.createDataFrame([("a", "n", None, "d")], schema)).collect()] == ["q"]
    drafts = spark.createDataFrame([("https://a", "t", "x"), ("https://a", "t", "y"), ("ftp://a", "t", "x"), (None, "t", "x")], "url string, title string, text string")
    assert tuple(replies.draft_counts(drafts).first()) == (4, 2, 1)
    listed = spark.createDataFrame([("new", "arXiv:1 Announce\nAbstract: body  x"), ("replace", "y")], "announce_type string, text string")
    assert [r["text"] for r in replies.announced(listed).collect()] == ["body x"]


def test_tables_of_versions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    graph.replace_all(spark, path, rows(("a", 1)), ["id"])
    (tmp_path / "t" / "v2").mkdir()  # a write that didn't end
    assert graph.versions(spark, path) == [1]
    graph.write_upsert(spark, path, rows(("a", 2), ("b", 3)).withColumn("_n", F.lit(1)), ["id"])
    assert {tuple(r) for r in graph.read_table(spark, path).collect()} == {("a", 2), ("b", 3)} and graph.by_id(graph.read_table(spark, path), "b").count() == 1
    wider = rows().schema.add("w", "string")
    assert graph.migrate(spark, path, wider, dry=True) == "additive" == graph.migrate(spark, path, wider) and graph.read_table(spark, path).columns == ["id", "v", "w"]
    assert graph.migrate(spark, path, rows().schema.__class__().add("id", "long")) == "incompatible" and graph.read_table(spark, path) is None
    lines = str(tmp_path / "lines")
    for day in ("2", "1"):
        graph.append_new(spark, lines, spark.createDataFrame([("n", day), ("m" + day, day)], "note string, day string"), ["note"])
    assert {tuple(r) for r in spark.read.schema("note string, day string").json(lines).collect()} == {("n", "2"), ("m2", "2"), ("m1", "1")}
    marks = spark.createDataFrame([("1", "used", None, D(2026, 1, 1)), ("2", "unused", None, D(2026, 1, 1))], "id string, verdict string, seen_on date, surfaced_on date")
    assert [tuple(r) for r in graph.violations(marks, graph.NODE_RULES["used_mark"]()).collect()] == [("1", "seen")]
    assert graph.fresh_requests(rows(("a", 1), ("a", 1), ("c", 1)), rows(("a", 9))).count() == 1


def test_items_keep_their_request(spark):
    import json

    reply = lambda *titles: json.dumps({"results": [{"title": t, "url": f"https://x/{t}", "content": " a  b ", "published_date": "2026-01-02"} for t in titles]})
    rows = spark.createDataFrame([("r1", "2026-01-01", reply("a", "b"), "own"), ("r2", "2026-01-01", reply("c"), "own"), ("r3", "2026-01-01", "{no json", "own")], "request string, day string, body string, title string")
    got = [tuple(r) for r in replies.web_results(rows, "body").drop("published").orderBy("request", "place").collect()]
    assert got == [("r1", "2026-01-01", 0, "a", "https://x/a", "a b"), ("r1", "2026-01-01", 1, "b", "https://x/b", "a b"), ("r2", "2026-01-01", 0, "c", "https://x/c", "a b")]
    items = spark.createDataFrame([("r1", 0, "u", ""), ("r1", 1, "v", None), ("r1", 2, "w", "has"), ("r2", 0, "v", " ")], "request string, place int, url string, text string")
    pages = spark.createDataFrame([("u", "page"), ("v", "a"), ("v", "late")], "url string, text string")
    found = {(r["request"], r["url"], r["text"], r["skipped"]) for r in replies.followed(items, pages, 1, ["request"]).collect()}
    assert found == {("r1", "u", "page", False), ("r1", "v", "", True), ("r1", "w", "has", False), ("r2", "v", "late", False)}
    stored = spark.createDataFrame([("i", "b"), ("i", "a")], "id string, net string")
    assert [tuple(r) for r in replies.first_nets(spark.createDataFrame([("i", "z"), ("j", "z")], "id string, net string"), stored).orderBy("id").collect()] == [("i", "a"), ("j", "z")]
