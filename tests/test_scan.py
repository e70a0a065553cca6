"""Scans of a tree that changes."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lookback.sources import keyed, scan

D = lambda n: F.lit(dt.date(2026, 4, n))


def put(root, path, text):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text) if isinstance(text, str) else file.write_bytes(text)


def files(spark, root, longest=1_000):
    read = lambda kind, pattern: scan.read_tree(spark, f"file://{root}/{kind}", pattern, longest).withColumn("kind", F.lit(kind))
    return read("graph", "*.jsonld").unionByName(read("adr", "*.md")).unionByName(read("vault", "*.md"))


def tree(root):
    put(root, "graph/a/graph.jsonld", json.dumps({"@graph": [{"x": "see https://arxiv.org/abs/2601.00001", "uü": ["doi 10.1234/ab.c"]}]}))
    put(root, "graph/b/graph.jsonld", '{broken https://x.org/page')
    put(root, "adr/0001.md", "https://arxiv.org/abs/2601.00001 and https://github.com/Me/own, https://github.com/you/theirs")
    put(root, "vault/top.md", "https://y.org/one")
    put(root, "vault/folder/deep/note.md", b"\xff\xfe https://z.org/two and https://github.com/you/theirs")
    put(root, "vault/folder/made.md", "---\nown_report: 1\n https://only.in/made")
    put(root, "vault/.trash/gone.md", "https://never.read/this")
    put(root, "vault/long.md", "https://late.org/key " + "x" * 2_000)


def rows(df, *names):
    return {r[0]: tuple(r)[1:] for r in df.select(*names).collect()}


def test_first_places_by_precedence(spark, tmp_path):
    tree(tmp_path)
    made = scan.scan(files(spark, tmp_path), owner="Me", own_mark="\nown_report:")
    found = rows(made.found, "key", "place")
    places = {k: p[0] for k, p in found.items()}
    assert places["arxiv:2601.00001"] == "graph" and places["doi:10.1234/ab.c"] == "graph" and places["url:x.org/page"] == "graph"
    assert places["gh:you/theirs"] == "adr" and places["url:y.org/one"] == "vault" and places["url:z.org/two"] == "vault:folder"
    assert not any(k.startswith("gh:me/") or "only.in" in k or "never.read" in k or "late.org" in k for k in places)
    assert [r["path"] for r in made.unread.collect()] == ["long.md"] and made.tainted.count() == 0


def test_scans_of_a_changing_tree_and_what_they_taint(spark, tmp_path):
    root, state = tmp_path / "tree", f"file://{tmp_path}/state"
    tree(root)
    assert scan.unread_before(spark, state) is None
    scan.record(spark, state, scan.scan(files(spark, root), scan.unread_before(spark, state)), D(1), 4)
    first = rows(keyed.read(spark, f"{state}/sightings"), "key", "place", "first_seen", "baseline", "unsure")
    assert first["url:y.org/one"] == ("vault", dt.date(2026, 4, 1), True, False)
    put(root, "vault/new.md", "https://new.org/found https://y.org/one")
    put(root, "vault/top.md", "nothing any more")
    # the long file can be read now
    scan.record(spark, state, scan.scan(files(spark, root, 10_000), scan.unread_before(spark, state)), D(2), 4)
    second = rows(keyed.read(spark, f"{state}/sightings"), "key", "place", "first_seen", "baseline", "unsure")
    assert {k: v for k, v in second.items() if k in first} == first
    assert second["url:new.org/found"] == ("vault", dt.date(2026, 4, 2), False, False)
    assert second["url:late.org/key"] == ("vault", dt.date(2026, 4, 2), False, True)
    assert {k for k, v in second.items() if v[3]} == {"url:late.org/key"}
    assert scan.unread_before(spark, state).count() == 0
    # the keys of both scans are those of one scan of the latest tree, and what has gone since
    whole = scan.scan(files(spark, root, 10_000))
    assert set(second) == {r["key"] for r in whole.found.collect()} | set(first)


def test_a_cut_scan_leaves_files_unread(spark, tmp_path):
    for n in range(9):
        put(tmp_path, f"vault/n{n}.md", f"https://k{n}.org/x " + "y" * 82)  # 101 bytes each
    listed = scan.read_tree(spark, f"file://{tmp_path}/vault", "*.md").withColumn("kind", F.lit("vault"))
    made = scan.scan(scan.within_budget(listed, 450))
    assert sorted(r["key"] for r in made.found.collect()) == [f"url:k{n}.org/x" for n in range(4)]
    assert sorted(r["path"] for r in made.unread.collect()) == [f"n{n}.md" for n in range(4, 9)]
    after = scan.scan(listed, made.unread)
    assert sorted(r["key"] for r in after.tainted.collect()) == [f"url:k{n}.org/x" for n in range(4, 9)]
